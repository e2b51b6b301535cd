"""Registered queries: scans, projections, filters, joins, aggregates, windows, sets, paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions.text import clamp_text
from ..shared import cut, new_folder
from ..sources import tree
from ..sources.adapters import changelog, files, import_edges, references, snapshots, symbols, table, with_views
from ..operators import retrieval as R
from ..operators import store as S
from .registry import query
from .retrieval import TEST_PATH, TEST_SQL, stored


def sql(key, statement):
    return query(key, with_views(statement))


def all_edges(spark, sf_dir):
    """Import edges and typed references in one shape."""
    i = import_edges(spark, sf_dir).select("source", "target", F.lit("import").alias("edge_type"), F.lit(1).cast("long").alias("usage_count"), F.lit(1.0).alias("confidence"), F.lit("parser").alias("provenance"))
    r = references(spark, sf_dir).withColumn("provenance", F.lit("ast"))
    return i.unionByName(r)


# --- scans ---------------------------------------------------------------------------------------------


@sql("src_scan", "select file_id, file_path, loc, file_hash, 'markdown' as language, 'docs' as cluster from files")
def src_scan(spark, sf_dir):
    f = files(spark, sf_dir)
    lines = F.size(F.split("text", "\r?\n")).cast("long")
    return f.select("file_id", "file_path", lines.alias("loc"), F.sha1("text").alias("file_hash"), M.language(F.col("file_path")).alias("language"), M.path_cluster(F.col("file_path")).alias("cluster"))


#: Where texts of documents and pages lie in a tree: folders by number, some of them passed over, and endings, some not read.
TREE_FOLDERS = ("src", "src/lib", "node_modules/x", "a.ts", "a", "Z", "z/.git", "z/.hidden", "_own", "tests", "src/test", "b/coverage", "b/out/c", "b/output", "ä", ".next", "c/d/e/f", "c/__tests__", "build")
TREE_ENDINGS = (".ts", ".md", ".txt", ".TSX", ".py", "", ".go", ".d.ts", ".json", ".sql", ".vue", ".mjs", ".rs2")
PLACED = f"""told as (select doc_id as k, 'd' as kind, text from documents where doc_id is not null union all select page_id, 'p', html from pages where page_id is not null),
tree as (select ({list(TREE_FOLDERS)})[k % {len(TREE_FOLDERS)} + 1] || '/' || kind || k || ({list(TREE_ENDINGS)})[k % {len(TREE_ENDINGS)} + 1] as path, coalesce(text, '') as text from told),
kept as (select path, text, row_number() over (order by string_split(path, '/')) as place from tree
  where not regexp_matches(path, '(^|/)(node_modules|dist|[.]git|[.]next|__tests__|tests|test|[.]turbo|[.]cache|coverage|build|out|[.]vercel|[.]svelte-kit|[.]nuxt|[.]output)/')
    and regexp_matches(lower(path), '[.](ts|tsx|js|jsx|mjs|cjs|sql|py|go|rs|java|kt|swift|vue|svelte|md)$'))"""


def file_tree(spark, sf_dir):
    """The texts of documents and pages as files in a tree; written once a session for each state of the tables."""

    def make(old):
        root = new_folder(spark, "tree")
        texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.lit("d").alias("kind"), "text").unionByName(table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.lit("p").alias("kind"), F.col("html").alias("text"))).where("k is not null")
        pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("k") % len(names) + 1).cast("int"))
        path = F.concat(pick(TREE_FOLDERS), F.lit("/"), "kind", F.col("k").cast("string"), pick(TREE_ENDINGS))
        tree.write(texts.select(path.alias("path"), "text"), root)
        return root

    return stored(spark, "tree", sf_dir, ("documents", "pages"), make)


@query("src_discover", f"with {PLACED} select place, path, strlen(text)::bigint as size from kept")
def src_discover(spark, sf_dir):
    """The files of a tree that are read, in the order of a walk."""
    return tree.walk(spark, file_tree(spark, sf_dir)).select("place", "path", "size")


@query("src_scan_tree", f"""with {PLACED} select path, sha1(text) as file_hash, len(string_split_regex(text, '\r?\n'))::bigint as loc, len(regexp_extract_all(text, 'href="[^"]+"'))::bigint as links from kept""")
def src_scan_tree(spark, sf_dir):
    """What a scan reads of each file: its hash, lines and links."""
    root = file_tree(spark, sf_dir)
    found = tree.read(tree.walk(spark, root).select("path"), root)
    links = F.size(F.regexp_extract_all("text", F.lit('href="[^"]+"'), F.lit(0))).cast("long")
    return found.select("path", F.sha1("text").alias("file_hash"), F.size(F.split("text", "\r?\n")).cast("long").alias("loc"), links.alias("links"))


@sql("src_discover_paths", "select file_path from files where not regexp_matches(file_path, '(^|/)(__tests__|tests|test)(/|$)') and regexp_matches(file_path, '\\.md$')")
def src_discover_paths(spark, sf_dir):
    """The same rule for paths that are known already."""
    return files(spark, sf_dir).where(M.scanned(F.col("file_path"))).select("file_path")


@sql("src_table_files", "select file_id, file_path, loc from files where workspace = 'ws1' order by file_path limit 100")
def src_table_files(spark, sf_dir):
    return files(spark, sf_dir).where("workspace = 'ws1'").select("file_id", "file_path", "loc").orderBy("file_path").limit(100)


@sql("src_table_imports", "select source, target from import_edges where target = (select min(target) from import_edges)")
def src_table_imports(spark, sf_dir):
    """Reverse lookup: who imports one file."""
    e = import_edges(spark, sf_dir)
    return e.join(F.broadcast(e.agg(F.min("target").alias("target"))), "target").select("source", "target")


@sql("src_table_symbols", "select symbol_id, file_path, name, raw_kind from symbols order by file_path, name limit 500")
def src_table_symbols(spark, sf_dir):
    return symbols(spark, sf_dir).select("symbol_id", "file_path", "name", "raw_kind").orderBy("file_path", "name").limit(500)


@sql("src_table_refs", "select source, target, edge_type, usage_count from refs order by source, target, edge_type limit 200")
def src_table_refs(spark, sf_dir):
    return references(spark, sf_dir).select("source", "target", "edge_type", "usage_count").orderBy("source", "target", "edge_type").limit(200)


@sql("src_point_get", "select file_id, file_path, file_hash, loc from files where workspace = 'ws1' and file_id = 13")
def src_point_get(spark, sf_dir):
    return files(spark, sf_dir).where("workspace = 'ws1' and file_id = 13").select("file_id", "file_path", "file_hash", "loc")


@sql("src_workspaces", "select workspace from files union select workspace from changelog")
def src_workspaces(spark, sf_dir):
    both = files(spark, sf_dir).select("workspace").union(changelog(spark, sf_dir).select("workspace"))
    return both.distinct().where(F.col("workspace").rlike("^[a-z0-9][a-z0-9._-]*$"))


set_union = sql("set_union_workspaces", "select workspace from files union select workspace from changelog")(lambda spark, sf_dir: src_workspaces(spark, sf_dir))


@sql("src_export_rows", "select f.file_id, f.file_path, e.label from files f left join embeddings e on e.vec_id = f.file_id where f.workspace in ('ws0', 'ws2')")
def src_export_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), "label")
    return files(spark, sf_dir).where(F.col("workspace").isin("ws0", "ws2")).select("file_id", "file_path").join(e, "file_id", "left")


@sql("src_federated", "select workspace, count(*)::bigint as n, min(file_path) as first from files group by workspace")
def src_federated(spark, sf_dir):
    """All workspaces' partitions as one frame."""
    f = files(spark, sf_dir)
    parts = [f.where(F.col("workspace") == w) for w in ("ws0", "ws1", "ws2")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("workspace").agg(F.count("*").alias("n"), F.min("file_path").alias("first"))


@sql("src_current_source", "select f.file_id, f.file_hash = sha1(case when f.file_id % 7 = 0 then f.text || '!' else f.text end) as unchanged from files f")
def src_current_source(spark, sf_dir):
    """The stored hash against the hash of the current source."""
    f = files(spark, sf_dir)
    now = f.select("file_id", F.when(F.col("file_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("now"))
    return f.select("file_id", "file_hash").join(now, "file_id").select("file_id", (F.col("file_hash") == F.sha1("now")).alias("unchanged"))


# --- projections and filters ---------------------------------------------------------------------------


@sql("prj_file_item", "select file_id, file_path, loc as line_count, substr(blurb, 1, 20) as blurb, array_to_string(patterns[1:1], ',') as patterns from files")
def prj_file_item(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", "file_path", F.col("loc").alias("line_count"), F.substring("blurb", 1, 20).alias("blurb"), F.array_join(F.slice("patterns", 1, 1), ",").alias("patterns"))


@sql("prj_file_record", "select file_id, extraction_model as extraction_provider, substr(purpose, 1, 200) as purpose, len(hazards)::int as hazards, len(tags)::int as tags from files")
def prj_file_record(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", F.col("extraction_model").alias("extraction_provider"), F.substring("purpose", 1, 200).alias("purpose"), F.size("hazards").alias("hazards"), F.size("tags").alias("tags"))


@sql("prj_changelog_item", "select id, file_path, summary, commit_sha as repository_revision, author_instance_id as principal_id, breaking_changes from changelog")
def prj_changelog_item(spark, sf_dir):
    return changelog(spark, sf_dir).select("id", "file_path", "summary", F.col("commit_sha").alias("repository_revision"), F.col("author_instance_id").alias("principal_id"), "breaking_changes")


@sql("flt_test_files", f"select file_id from files where not {TEST_SQL}")
def flt_test_files(spark, sf_dir):
    return files(spark, sf_dir).where(~F.col("file_path").rlike(TEST_PATH)).select("file_id")


# What each older tool takes for a test or, for reachability, a configuration file.
LEGACY_TESTS = {
    "smells": r"(?i)/(__tests__|__mocks__|tests?|spec|fixtures)/|\.(test|spec)\.[cm]?[jt]sx?$",
    "cycles": r"(?i)/(__tests__|tests?|spec)/|\.(test|spec)\.[cm]?[jt]sx?$",
    "hotspots": r"(?i)(^|/)(__tests__|test)(/|$)|\.(test|spec)\.[cm]?[jt]sx?$",
    "reachability": r"(?i)/(__tests__|__mocks__|tests?|specs?|fixtures)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)[^/]*\.config\.[cm]?[jt]s$",
}
LEGACY_PATH = "replace(replace(file_path, '.spec.md', '.spec.ts'), 'doc_7.md', 'vite.config.ts')"


@sql("flt_test_files_legacy", f"select file_id, {', '.join(f"regexp_matches({LEGACY_PATH}, '{p}') as {n}" for n, p in LEGACY_TESTS.items())} from files")
def flt_test_files_legacy(spark, sf_dir):
    """The four older variants of the test filter, side by side."""
    path = F.expr(LEGACY_PATH)
    return files(spark, sf_dir).select("file_id", *[path.rlike(p).alias(n) for n, p in LEGACY_TESTS.items()])


@sql("flt_files", f"select file_id, file_path from files where not {TEST_SQL} and starts_with(file_path, 'src/src1') and cluster = 'src1'")
def flt_files(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.where(~F.col("file_path").rlike(TEST_PATH) & F.col("file_path").startswith("src/src1") & (F.col("cluster") == "src1")).select("file_id", "file_path")


@sql("flt_changelog", "select id from changelog where workspace = 'ws1' and starts_with(file_path, 'src/user_1') and cluster = 'click' and created_at >= timestamp '2024-01-05' and created_at <= timestamp '2024-01-20' and verification_status = 'verified' and not breaking_changes and author_name is not null")
def flt_changelog(spark, sf_dir):
    """All optional conditions at once; only those given become predicates."""
    c = changelog(spark, sf_dir)
    given = [F.col("workspace") == "ws1", F.col("file_path").startswith("src/user_1"), F.col("cluster") == "click", F.col("created_at") >= F.lit("2024-01-05").cast("timestamp"), F.col("created_at") <= F.lit("2024-01-20").cast("timestamp"), F.col("verification_status") == "verified", ~F.col("breaking_changes"), F.col("author_name").isNotNull()]
    for condition in given:
        c = c.where(condition)
    return c.select("id")


@sql("flt_edge_types", "select source, target, edge_type from all_edges where edge_type in ('import', 'runtime_call')")
def flt_edge_types(spark, sf_dir):
    return all_edges(spark, sf_dir).where(F.col("edge_type").isin("import", "runtime_call")).select("source", "target", "edge_type")


@sql("flt_min_severity", "with s as (select file_id, case when loc > 60 then 'high' when loc > 20 then 'medium' else 'low' end as severity from files) select file_id, severity from s where case severity when 'high' then 3 when 'medium' then 2 else 1 end >= 2")
def flt_min_severity(spark, sf_dir):
    s = files(spark, sf_dir).select("file_id", F.when(F.col("loc") > 60, "high").when(F.col("loc") > 20, "medium").otherwise("low").alias("severity"))
    return s.where(M.severity_rank(F.col("severity")) >= 2)


@sql("flt_like_search", "select file_id from files where contains(lower(file_path), 'doc_9') or contains(lower(blurb), 'thation') or contains(lower(purpose), 'thation') or contains(lower(array_to_string(tags, ' ')), 'doc_9')")
def flt_like_search(spark, sf_dir):
    """Any word in any column."""
    columns = [F.col("file_path"), F.col("blurb"), F.col("purpose"), F.array_join("tags", " ")]
    condition = F.lit(False)
    for c in columns:
        for word in ("doc_9", "thation"):
            condition = condition | F.coalesce(F.contains(F.lower(c), F.lit(word)), F.lit(False))
    return files(spark, sf_dir).where(condition).select("file_id")


query("flt_like_search_all", with_views("select file_id from files where contains(lower(concat_ws(' ', file_path, blurb, purpose, array_to_string(tags, ' '))), 'doc_9') or contains(lower(concat_ws(' ', file_path, blurb, purpose, array_to_string(tags, ' '))), 'thation')"))(
    lambda spark, sf_dir: files(spark, sf_dir).where(F.lower(F.concat_ws(" ", "file_path", "blurb", "purpose", F.array_join("tags", " "))).rlike("doc_9|thation")).select("file_id")
)


@sql("flt_catalog", "select file_id from files where contains(lower(file_path || ' ' || coalesce(blurb, '')), 'ing')")
def flt_catalog(spark, sf_dir):
    return files(spark, sf_dir).where(F.contains(F.lower(F.concat_ws(" ", "file_path", F.coalesce("blurb", F.lit("")))), F.lit("ing"))).select("file_id")


@sql("flt_catalog_detailed", "select file_path, case when length(coalesce(nullif(purpose, ''), blurb)) <= 40 then coalesce(nullif(purpose, ''), blurb) else substr(coalesce(nullif(purpose, ''), blurb), 1, 39) || '…' end as summary from files where contains(lower(concat_ws(' ', file_path, cluster, blurb, purpose, array_to_string(tags, ' '), array_to_string(patterns, ' '))), 'src3') order by file_path limit 50 offset 20")
def flt_catalog_detailed(spark, sf_dir):
    f = files(spark, sf_dir)
    hay = F.lower(F.concat_ws(" ", "file_path", "cluster", "blurb", "purpose", F.array_join("tags", " "), F.array_join("patterns", " ")))
    text = F.coalesce(F.nullif("purpose", F.lit("")), F.col("blurb"))
    return f.where(F.contains(hay, F.lit("src3"))).select("file_path", clamp_text(text, 40).alias("summary")).orderBy("file_path").offset(20).limit(50)


@sql("flt_canonical_path", "select file_id, case when file_id % 4 = 3 then null when file_id % 4 = 2 then 'src/' || language || '/a.md' else file_path end as path from files")
def flt_canonical_path(spark, sf_dir):
    i, p = F.col("file_id"), F.col("file_path")
    raw = F.when(i % 4 == 0, F.concat(F.lit("./"), p)).when(i % 4 == 1, F.replace(p, F.lit("/"), F.lit("//"))).when(i % 4 == 2, F.concat(F.lit("src/x/../"), F.col("language"), F.lit("/./a.md"))).otherwise(F.concat(F.lit("a/../../"), p))
    return files(spark, sf_dir).select("file_id", M.canonical_path(raw).alias("path"))


@sql("flt_pattern_files", "select file_id from files where list_contains(patterns, 'p3')")
def flt_pattern_files(spark, sf_dir):
    return files(spark, sf_dir).where(F.array_contains("patterns", "p3")).select("file_id")


@sql("flt_pending_changelog", "select id from changelog where commit_sha is null and file_path in (select distinct file_path from changelog where breaking_changes) order by created_at desc, id desc limit 200")
def flt_pending_changelog(spark, sf_dir):
    c = changelog(spark, sf_dir)
    wanted = c.where("breaking_changes").select("file_path").distinct()
    return c.where("commit_sha is null").join(wanted, "file_path", "left_semi").orderBy(F.desc("created_at"), F.desc("id")).limit(200).select("id")


@sql("flt_prefix_filters", "select file_id from files where file_path = 'src/src1' or starts_with(file_path, 'src/src1/') or starts_with(file_path, 'src/src2/')")
def flt_prefix_filters(spark, sf_dir):
    """Equal to a path or under it."""
    p = F.col("file_path")
    under = lambda root: (p == root) | p.startswith(root + "/")
    return files(spark, sf_dir).where(under("src/src1") | under("src/src2")).select("file_id")


@sql("flt_worktree_ignore", "select file_id from files where not (list_contains(string_split(file_path, '/'), '__tests__') or list_contains(string_split(file_path, '/'), 'fr'))")
def flt_worktree_ignore(spark, sf_dir):
    return files(spark, sf_dir).where(~F.arrays_overlap(F.split("file_path", "/"), F.array(F.lit("__tests__"), F.lit("fr")))).select("file_id")


# --- joins ---------------------------------------------------------------------------------------------


@sql("jn_usage_left", "select s.symbol_id, coalesce(sum(r.usage_count), 0)::bigint as usages, count(distinct r.source)::bigint as consumers from symbols s left join refs r on r.target = s.file_path and r.edge_type in ('runtime_call', 'CALLS') and r.source <> s.file_path group by s.symbol_id")
def jn_usage_left(spark, sf_dir):
    """Left join with a residual condition, which stays in the join."""
    s, r = symbols(spark, sf_dir), references(spark, sf_dir)
    on = (r["target"] == s["file_path"]) & r["edge_type"].isin("runtime_call", "CALLS") & (r["source"] != s["file_path"])
    return s.join(r, on, "left").groupBy("symbol_id").agg(F.coalesce(F.sum("usage_count"), F.lit(0)).alias("usages"), F.count_distinct("source").alias("consumers"))


@sql("jn_event_pairs", "select a.file_path as emitter, b.file_path as listener, count(*)::bigint as pairs from changelog a join changelog b on a.created_at::date = b.created_at::date and a.cluster = 'purchase' and b.cluster = 'error' group by all")
def jn_event_pairs(spark, sf_dir):
    """Emitters and listeners of one event name (here a day). Duplicates count, but are added up before
    they meet, so that a frequent name costs its emitters times its listeners and not its events squared."""
    c = changelog(spark, sf_dir).withColumn("name", F.to_date("created_at").cast("string")).where("name is not null")
    side = lambda kind, who: cut(c.where(F.col("cluster") == kind).groupBy("name", F.col("file_path").alias(who)).agg(F.count("*").alias("n")))
    return R.joint_counts(side("purchase", "emitter"), side("error", "listener"), "name", "emitter", "listener", "n", "pairs")


RESOLVE = """with calls as (select r.source, r.target, s.name from refs r join symbols s on s.file_path = r.target),
cand as (select c.source, c.target, c.name, s.symbol_id, s.exported, case when s.file_path = c.source then 1 when i.source is not null then 2 when s.exported then 3 end as priority
  from calls c join symbols s on s.name = c.name left join import_edges i on i.source = c.source and i.target = s.file_path),
guarded as (select *, count(*) filter (priority = 3) over (partition by source, target, name) as n3 from (select distinct * from cand) where priority is not null)
"""


def resolved(spark, sf_dir, guarded):
    """(source, target, name, symbol_id, priority): the caller's own file, then a file it imports, then an
    export of that name, which ``guarded`` must be the only one. Each priority is an equi-join with symbols
    that were reduced to one row a key first, so a frequent name costs its callers and not its bearers too."""
    r, s, i = references(spark, sf_dir), symbols(spark, sf_dir), import_edges(spark, sf_dir)
    calls = r.join(s.select(F.col("file_path").alias("target"), "name"), "target").select("source", "target", "name").distinct()
    own = s.groupBy("file_path", "name").agg(F.min("symbol_id").alias("found"))
    first = own.select(F.col("file_path").alias("source"), "name", F.col("found").alias("one"))
    met = calls.join(i.select("source", F.col("target").alias("file_path")), "source").join(own, ["file_path", "name"])
    second = met.groupBy("source", "target", "name").agg(F.min("found").alias("two"))
    third = s.where("exported").groupBy("name").agg(F.min("symbol_id").alias("three"), F.count("*").alias("bearers"))
    third = third.where("bearers = 1") if guarded else third
    out = calls.join(first, ["source", "name"], "left").join(second, ["source", "target", "name"], "left").join(third.drop("bearers"), "name", "left")
    found = F.coalesce("one", "two", "three")
    priority = F.when(F.col("one").isNotNull(), 1).when(F.col("two").isNotNull(), 2).otherwise(3)
    return out.where(found.isNotNull()).select("source", "target", "name", found.alias("symbol_id"), priority.alias("priority"))


@sql("jn_symbol_resolve_struct", RESOLVE + """select source, target, name, symbol_id, case priority when 1 then 1.0 when 2 then 0.9 else 0.7 end::double as confidence from guarded where priority < 3 or n3 = 1
qualify row_number() over (partition by source, target, name order by priority, symbol_id) = 1""")
def jn_symbol_resolve_struct(spark, sf_dir):
    """Own file, then an imported one, then an export that is the only one of its name."""
    confidence = F.when(F.col("priority") == 1, 1.0).when(F.col("priority") == 2, 0.9).otherwise(0.7)
    return resolved(spark, sf_dir, True).select("source", "target", "name", "symbol_id", confidence.alias("confidence"))


@sql("jn_symbol_resolve_flow", RESOLVE + "select source, target, name, min(symbol_id) as symbol_id from (select *, min(priority) over (partition by source, target, name) as best from guarded) where priority = best group by all")
def jn_symbol_resolve_flow(spark, sf_dir):
    """The same priorities, without the guard: the first of the best."""
    return resolved(spark, sf_dir, False).select("source", "target", "name", "symbol_id")


@sql("jn_asof_snapshot", "with t as (select 'conv_' || conv_id as file_path, (1500 * turn + 500)::bigint as at from conversations) select t.file_path, t.at, s.id from t asof join snapshots s on t.file_path = s.file_path and s.created_at <= t.at")
def jn_asof_snapshot(spark, sf_dir):
    """The newest version at or before each instant, by union and a running maximum: one shuffle, one
    sort, no pairs."""
    t = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("file_path"), (1500 * F.col("turn") + 500).cast("long").alias("at"))
    s = snapshots(spark, sf_dir).select("file_path", F.col("created_at").alias("at"), "id")
    both = s.withColumn("probe", F.lit(1)).unionByName(t.withColumn("id", F.lit(None).cast("long")).withColumn("probe", F.lit(2)))
    w = Window.partitionBy("file_path").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("id", F.last("id", ignorenulls=True).over(w)).where("probe = 2 and id is not null").select("file_path", "at", "id")


@sql("jn_asof_timestamp", "select file_path, max(id) filter (created_at = m) as id from (select *, max(created_at) over (partition by file_path) as m from changelog where created_at <= timestamp '2024-01-15 23:59:59') group by file_path")
def jn_asof_timestamp(spark, sf_dir):
    """The last change of each file at or before an instant; a date means its last second."""
    c = changelog(spark, sf_dir).where(F.col("created_at") <= F.lit("2024-01-15 23:59:59").cast("timestamp"))
    return c.groupBy("file_path").agg(F.max(F.struct("created_at", "id")).alias("last")).select("file_path", "last.id")


@sql("jn_interval_highlight", "with h as (select p_partkey as hid, p_brand as file, p_size::bigint as a, (p_size + 5)::bigint as b from part), c as (select distinct p_brand as file, (p_partkey * 13 % 400)::bigint as line from part) select distinct h.hid from h join c on h.file = c.file and c.line between h.a and h.b")
def jn_interval_highlight(spark, sf_dir):
    """Ranges that hold a changed line. Lines are dealt to cells as wide as ranges may be, so that the
    join has an equality on the cell."""
    p = table(spark, sf_dir, "part")
    width = 8
    h = p.select(F.col("p_partkey").alias("hid"), F.col("p_brand").alias("file"), F.col("p_size").cast("long").alias("a"), (F.col("p_size") + 5).cast("long").alias("b"))
    h = h.withColumn("cell", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor(F.col("b") / width))))
    c = p.select(F.col("p_brand").alias("file"), (F.col("p_partkey") * 13 % 400).cast("long").alias("line")).distinct().withColumn("cell", F.floor(F.col("line") / width))
    return h.join(c, ["file", "cell"]).where("line between a and b").select("hid").distinct()


@sql("jn_neighbors_semi", "select source, target, edge_type from all_edges where source in (select file_path from symbols where exported) and target in (select file_path from symbols where exported)")
def jn_neighbors_semi(spark, sf_dir):
    nodes = symbols(spark, sf_dir).where("exported").select("file_path")
    e = all_edges(spark, sf_dir).select("source", "target", "edge_type")
    return e.join(nodes.withColumnRenamed("file_path", "source"), "source", "left_semi").join(nodes.withColumnRenamed("file_path", "target"), "target", "left_semi").select("source", "target", "edge_type")


@sql("jn_dead_exports_anti", "select symbol_id, name from symbols where exported and file_path not in (select target from refs)")
def jn_dead_exports_anti(spark, sf_dir):
    return symbols(spark, sf_dir).where("exported").join(references(spark, sf_dir).select(F.col("target").alias("file_path")), "file_path", "left_anti").select("symbol_id", "name")


@sql("jn_deleted_anti", "select file_path from files where file_id % 11 = 4")
def jn_deleted_anti(spark, sf_dir):
    """Stored paths that the current scan lacks."""
    f = files(spark, sf_dir).select("file_id", "file_path")
    return f.join(f.where("file_id % 11 <> 4").select("file_path"), "file_path", "left_anti").select("file_path")


@sql("set_except_deleted", "select file_path from files except select file_path from files where file_id % 11 <> 4")
def set_except_deleted(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("file_path").subtract(f.where("file_id % 11 <> 4").select("file_path"))


@sql("jn_prune_notin", "select id from changelog qualify row_number() over (partition by file_path order by created_at desc, id desc) <= 10")
def jn_prune_notin(spark, sf_dir):
    """The ten newest of each file stay."""
    w = Window.partitionBy("file_path").orderBy(F.desc("created_at"), F.desc("id"))
    return changelog(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("id")


query("win_keep_newest", with_views("select file_path, count(*)::bigint as kept, min(created_at) as oldest from (select * from changelog qualify row_number() over (partition by file_path order by created_at desc, id desc) <= 10) group by file_path"))(
    lambda spark, sf_dir: changelog(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("created_at"), F.desc("id")))).where("rn <= 10").groupBy("file_path").agg(F.count("*").alias("kept"), F.min("created_at").alias("oldest"))
)


@sql("jn_worktree_compare", """with store as (select file_path, file_hash from files where file_id % 13 <> 5), disk as (select file_path, sha1(case when file_id % 7 = 0 then text || '!' else text end) as now from files where file_id % 11 <> 4)
select coalesce(s.file_path, d.file_path) as file_path, case when s.file_path is null then 'untracked' when d.file_path is null then 'deleted' when s.file_hash = d.now then 'clean' else 'modified' end as status from store s full join disk d on s.file_path = d.file_path""")
def jn_worktree_compare(spark, sf_dir):
    """Store against disk, both sides kept."""
    f = files(spark, sf_dir)
    store = f.where("file_id % 13 <> 5").select("file_path", "file_hash", F.lit(True).alias("stored"))
    disk = f.where("file_id % 11 <> 4").select("file_path", F.sha1(F.when(F.col("file_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("now"), F.lit(True).alias("found"))
    status = F.when(F.col("stored").isNull(), "untracked").when(F.col("found").isNull(), "deleted").when(F.col("file_hash") == F.col("now"), "clean").otherwise("modified")
    return store.join(disk, "file_path", "full").select("file_path", status.alias("status"))


@sql("jn_changed_files", "select file_path from files where file_id % 7 = 0 or file_id % 13 = 5")
def jn_changed_files(spark, sf_dir):
    """New or different: left join and null-safe inequality of hashes."""
    f = files(spark, sf_dir)
    before = f.where("file_id % 13 <> 5").select("file_path", "file_hash")
    now = f.select("file_path", F.sha1(F.when(F.col("file_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("now"))
    return now.join(before, "file_path", "left").where(~F.col("now").eqNullSafe(F.col("file_hash"))).select("file_path")


@sql("jn_cluster_edges", "select a.p_brand as source_cluster, b.p_brand as target_cluster, count(*)::bigint as weight from import_edges e join part a on e.source = 'part_' || lpad(a.p_partkey::varchar, 6, '0') join part b on e.target = 'part_' || lpad(b.p_partkey::varchar, 6, '0') group by all")
def jn_cluster_edges(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("part_"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("file"), "p_brand")
    e = import_edges(spark, sf_dir)
    e = e.join(p.select(F.col("file").alias("source"), F.col("p_brand").alias("source_cluster")), "source").join(p.select(F.col("file").alias("target"), F.col("p_brand").alias("target_cluster")), "target")
    return e.groupBy("source_cluster", "target_cluster").agg(F.count("*").alias("weight"))


# --- aggregates ----------------------------------------------------------------------------------------


@sql("agg_history_count", "select count(*)::bigint as n, min(created_at) as first, max(created_at) as last from changelog where workspace = 'ws1'")
def agg_history_count(spark, sf_dir):
    return changelog(spark, sf_dir).where("workspace = 'ws1'").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


for _column in ("file_path", "cluster", "author_name", "author_instance_id", "author_engine", "author_model", "author_engine_type", "verification_status"):

    def _group(spark, sf_dir, column=_column):
        key = F.coalesce(F.col(column).cast("string"), F.lit("(none)")).alias("key")
        out = changelog(spark, sf_dir).groupBy(key).agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
        return out.orderBy(F.desc("n"), "key").limit(100)

    sql(f"agg_history_group_{_column}", f"select coalesce({_column}::varchar, '(none)') as key, count(*)::bigint as n, min(created_at) as first, max(created_at) as last from changelog group by 1 order by n desc, key limit 100")(_group)


@sql("agg_history_group_count", "select (select count(*) from (select distinct author_name from changelog))::bigint as authors, (select count(*) from (select distinct cluster from changelog))::bigint as clusters")
def agg_history_group_count(spark, sf_dir):
    """Null counts as a group."""
    c = changelog(spark, sf_dir)
    return c.agg((F.count_distinct("author_name") + F.max(F.col("author_name").isNull().cast("int"))).alias("authors"), (F.count_distinct("cluster") + F.max(F.col("cluster").isNull().cast("int"))).alias("clusters"))


def week(d):
    """Week of the year, Monday first, as %Y-W%W has it."""
    number = F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7)
    return F.concat(F.date_format(d, "yyyy"), F.lit("-W"), F.lpad(number.cast("string"), 2, "0"))


for _bucket, _spark, _sql in (("day", lambda d: F.date_format(d, "yyyy-MM-dd"), "%Y-%m-%d"), ("week", week, "%Y-W%W"), ("month", lambda d: F.date_format(d, "yyyy-MM"), "%Y-%m")):

    def _timeline(spark, sf_dir, bucket=_spark):
        c = changelog(spark, sf_dir).withColumn("bucket", bucket(F.col("created_at")))
        return c.groupBy("bucket").agg(F.count("*").alias("changes"), F.count_distinct("file_path").alias("files"), F.count_distinct(F.coalesce("author_name", "author_instance_id")).alias("authors"), F.count_if("breaking_changes").alias("breaking"))

    sql(f"agg_history_timeline_{_bucket}", f"select strftime(created_at, '{_sql}') as bucket, count(*)::bigint as changes, count(distinct file_path)::bigint as files, count(distinct coalesce(author_name, author_instance_id))::bigint as authors, count(*) filter (breaking_changes)::bigint as breaking from changelog group by 1")(_timeline)


@sql("agg_patterns", "select pattern, count(*)::bigint as files from (select unnest(patterns) as pattern from files) group by pattern")
def agg_patterns(spark, sf_dir):
    return files(spark, sf_dir).select(F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("files"))


@sql("agg_patterns_distinct", "select distinct pattern from (select unnest(patterns) as pattern from files) order by pattern limit 1000")
def agg_patterns_distinct(spark, sf_dir):
    return files(spark, sf_dir).select(F.explode("patterns").alias("pattern")).distinct().orderBy("pattern").limit(1000)


@sql("agg_patterns_count", "select count(distinct pattern)::bigint as n from (select unnest(patterns) as pattern from files)")
def agg_patterns_count(spark, sf_dir):
    return files(spark, sf_dir).select(F.explode("patterns").alias("pattern")).agg(F.count_distinct("pattern").alias("n"))


@sql("agg_clusters", "select coalesce(cluster, 'uncategorized') as cluster, count(*)::bigint as files from files group by 1")
def agg_clusters(spark, sf_dir):
    return files(spark, sf_dir).groupBy(F.coalesce("cluster", F.lit("uncategorized")).alias("cluster")).agg(F.count("*").alias("files"))


@sql("agg_cluster_graph", "with e as (select a.p_brand as s, b.p_brand as t, count(*) as weight from import_edges e join part a on e.source = 'part_' || lpad(a.p_partkey::varchar, 6, '0') join part b on e.target = 'part_' || lpad(b.p_partkey::varchar, 6, '0') group by all), i as (select c, sum(weight) as total from (select s as c, weight from e union all select t, weight from e where s <> t) group by c) select e.s as source, e.t as target, e.weight::bigint as weight, (e.weight >= 0.5 * i.total) as dominant from e join i on i.c = e.s")
def agg_cluster_graph(spark, sf_dir):
    e = jn_cluster_edges(spark, sf_dir)
    ends = e.select(F.col("source_cluster").alias("c"), "weight").unionByName(e.where("source_cluster <> target_cluster").select(F.col("target_cluster").alias("c"), "weight"))
    total = ends.groupBy("c").agg(F.sum("weight").alias("total"))
    return e.join(total, F.col("c") == F.col("source_cluster")).select(F.col("source_cluster").alias("source"), F.col("target_cluster").alias("target"), "weight", (F.col("weight") >= 0.5 * F.col("total")).alias("dominant"))


@sql("agg_degree", "select node, count(*)::bigint as degree from (select source as node from all_edges union all select target from all_edges) group by node")
def agg_degree(spark, sf_dir):
    return degrees(all_edges(spark, sf_dir))


def degrees(edges):
    """Edges at each node; a self-edge counts twice."""
    return edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


@sql("agg_fan", "select coalesce(a.n, b.n) as node, coalesce(fan_in, 0)::bigint as fan_in, coalesce(fan_out, 0)::bigint as fan_out from (select target as n, count(*) as fan_in from import_edges group by 1) a full join (select source as n, count(*) as fan_out from import_edges group by 1) b on a.n = b.n")
def agg_fan(spark, sf_dir):
    return fans(import_edges(spark, sf_dir))


def fans(edges):
    """Edges into and out of each node, in one shuffle."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


@sql("agg_ref_usage", "select node, sum(usage_count)::bigint as usages from (select source as node, usage_count from refs union all select target, usage_count from refs) group by node")
def agg_ref_usage(spark, sf_dir):
    r = references(spark, sf_dir)
    return r.select(F.explode(F.array("source", "target")).alias("node"), "usage_count").groupBy("node").agg(F.sum("usage_count").alias("usages"))


@sql("agg_churn", "select file_path, count(*)::bigint as changes, count(*) filter (breaking_changes)::bigint as breaking from changelog where created_at >= timestamp '2024-01-10' group by file_path")
def agg_churn(spark, sf_dir):
    c = changelog(spark, sf_dir).where(F.col("created_at") >= F.lit("2024-01-10").cast("timestamp"))
    return c.groupBy("file_path").agg(F.count("*").alias("changes"), F.count_if("breaking_changes").alias("breaking"))


@sql("agg_usages", "select s.symbol_id, r.source, r.edge_type, sum(r.usage_count)::bigint as usages from symbols s join refs r on r.target = s.file_path group by all")
def agg_usages(spark, sf_dir):
    s = symbols(spark, sf_dir).select("symbol_id", F.col("file_path").alias("target"))
    return references(spark, sf_dir).join(s, "target").groupBy("symbol_id", "source", "edge_type").agg(F.sum("usage_count").alias("usages"))


CALL_TYPE = "case edge_type when 'CALLS' then 'call' when 'runtime_call' then 'call' else 'type-reference' end"


@sql("agg_call_sites", f"select symbol_id, string_agg(source || ':' || kind || ':' || n, ',' order by n desc, source, kind) as sites from (select s.symbol_id, r.source, {CALL_TYPE} as kind, sum(greatest(1, usage_count))::bigint as n from symbols s join refs r on r.target = s.file_path group by all) group by symbol_id")
def agg_call_sites(spark, sf_dir):
    s = symbols(spark, sf_dir).select("symbol_id", F.col("file_path").alias("target"))
    kind = F.when(F.col("edge_type").isin("CALLS", "runtime_call"), "call").otherwise("type-reference").alias("kind")
    per = references(spark, sf_dir).join(s, "target").groupBy("symbol_id", "source", kind).agg(F.sum(F.greatest("usage_count", F.lit(1))).alias("n"))
    listed = per.groupBy("symbol_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "source", "kind"))).alias("x"))
    return listed.select("symbol_id", F.array_join(F.transform("x", lambda r: F.concat_ws(":", r["source"], r["kind"], (-r["m"]).cast("string"))), ",").alias("sites"))


@sql("agg_blast_radius", "select s.symbol_id, case when count(distinct r.source) <= 1 then 'low' when count(distinct r.source) <= 5 then 'medium' when count(distinct r.source) <= 15 then 'high' else 'critical' end as radius from symbols s left join refs r on r.target = s.file_path group by s.symbol_id")
def agg_blast_radius(spark, sf_dir):
    s = symbols(spark, sf_dir).select("symbol_id", F.col("file_path").alias("target"))
    return s.join(references(spark, sf_dir), "target", "left").groupBy("symbol_id").agg(M.blast_radius(F.count_distinct("source")).alias("radius"))


FILLED = "list_filter([case when coalesce(blurb, '') <> '' then 'blurb' end, case when coalesce(purpose, '') <> '' then 'purpose' end, case when len(tags) > 0 then 'tags' end, case when len(hazards) > 0 then 'hazards' end, case when len(patterns) > 0 then 'patterns' end], lambda x: x is not null)"
TIER = "case when loc <= 0 then 'small' when loc <= 50 then 'tiny' when loc <= 200 then 'small' when loc <= 600 then 'medium' when loc <= 1500 then 'large' else 'huge' end"


def filled_fields():
    text = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return M.filled({"blurb": text("blurb"), "purpose": text("purpose"), "tags": F.size("tags") > 0, "hazards": F.size("hazards") > 0, "patterns": F.size("patterns") > 0})


@sql("agg_completeness", f"""with t as (select file_id, {TIER} as tier, {FILLED} as filled from files),
r as (select *, case tier when 'tiny' then ['blurb', 'tags'] when 'small' then ['blurb', 'purpose', 'tags'] when 'medium' then ['blurb', 'purpose', 'tags', 'hazards'] when 'large' then ['blurb', 'purpose', 'tags', 'hazards', 'patterns', 'source_highlights'] else ['blurb', 'purpose', 'tags', 'hazards', 'patterns', 'source_highlights', 'key_types'] end as required from t)
select file_id, tier, round(len(list_intersect(required, filled))::double / len(required), 6) as required_rate, len(filled) / 10.0::double as overall_rate from r""")
def agg_completeness(spark, sf_dir):
    t = files(spark, sf_dir).select("file_id", M.tier(F.col("loc")).alias("tier"), filled_fields().alias("filled"))
    t = t.withColumn("required", M.required(F.col("tier")))
    rate = F.size(F.array_intersect("required", "filled")) / F.size("required")
    return t.select("file_id", "tier", F.round(rate, 6).alias("required_rate"), (F.size("filled") / 10.0).alias("overall_rate"))


@sql("agg_coverage", """with c as (select workspace, list_filter(['purpose', 'blurb', 'patterns', 'hazards', 'conventions', 'key_types', 'data_flows', 'public_api', 'source_highlights'], lambda f: case f when 'purpose' then trim(coalesce(purpose, '')) = '' when 'blurb' then trim(coalesce(blurb, '')) = '' when 'patterns' then len(patterns) = 0 when 'hazards' then len(hazards) = 0
  when 'conventions' then len(conventions) = 0 when 'key_types' then len(key_types) = 0 when 'data_flows' then len(data_flows) = 0 when 'public_api' then len(exports) = 0 else len(source_highlights) = 0 end) as empty from files)
select workspace, round(avg((9 - len(empty)) / 9.0::double), 6) as coverage, sum(len(empty))::bigint as empty from c group by workspace""")
def agg_coverage(spark, sf_dir):
    """How many of nine fields are filled."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    gaps = [blank("purpose"), blank("blurb"), *[F.size(c) == 0 for c in ("patterns", "hazards", "conventions", "key_types", "data_flows", "exports", "source_highlights")]]
    empty = sum((g.cast("int") for g in gaps), F.lit(0))
    return files(spark, sf_dir).groupBy("workspace").agg(F.round(F.avg((9 - empty) / 9.0), 6).alias("coverage"), F.sum(empty).cast("long").alias("empty"))


@sql("agg_enrichment_rollup", f"select field, count(*)::bigint as files, min(file_path) as example from (select file_path, unnest(list_filter(['blurb', 'purpose', 'tags', 'hazards', 'patterns'], lambda f: not list_contains({FILLED}, f))) as field from files) group by field")
def agg_enrichment_rollup(spark, sf_dir):
    f = files(spark, sf_dir).select("file_path", F.explode(F.array_except(F.array(*[F.lit(x) for x in ("blurb", "purpose", "tags", "hazards", "patterns")]), filled_fields())).alias("field"))
    return f.groupBy("field").agg(F.count("*").alias("files"), F.min("file_path").alias("example"))


@sql("agg_verification_breakdown", "select verification_status, count(*)::bigint as n from (select * from changelog order by created_at desc, id desc limit 50) group by 1")
def agg_verification_breakdown(spark, sf_dir):
    """Over the page returned, not over all."""
    page = changelog(spark, sf_dir).select("verification_status", "created_at", "id").orderBy(F.desc("created_at"), F.desc("id")).limit(50)
    return page.groupBy("verification_status").agg(F.count("*").alias("n"))


@sql("agg_index_summary", """with l as (select file_path || chr(0) || file_hash as line, file_path, file_id, extraction_model, substr(sha256(file_path), 1, 3) as cell from files where workspace = 'ws1'),
c as (select cell, sha256(string_agg(line, chr(10) order by file_path)) as digest, count(*) as files, count(*) filter (file_id % 7 = 0) as changed, count(*) filter (extraction_model is null) as stale from l group by cell)
select sha256(string_agg(digest, chr(10) order by cell)) as fingerprint, sum(files)::bigint as files, sum(changed)::bigint as changed, sum(stale)::bigint as stale from c""")
def agg_index_summary(spark, sf_dir):
    """One workspace's fingerprint in two levels: 4,096 cells by the digest of the path, each the digest of
    its lines in order, then the digest of the cells."""
    f = files(spark, sf_dir).where("workspace = 'ws1'").withColumn("cell", F.substring(F.sha2("file_path", 256), 1, 3))
    line = F.struct("file_path", F.concat("file_path", F.lit("\x00"), "file_hash").alias("line"))
    cells = f.groupBy("cell").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"), 256).alias("digest"), F.count("*").alias("files"), F.count_if(F.col("file_id") % 7 == 0).alias("changed"), F.count_if(F.col("extraction_model").isNull()).alias("stale"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("cell", "digest"))), lambda x: x["digest"])
    return cells.agg(F.sha2(F.array_join(digests, "\n"), 256).alias("fingerprint"), F.sum("files").alias("files"), F.sum("changed").alias("changed"), F.sum("stale").alias("stale"))


# --- windows, sets, paging -----------------------------------------------------------------------------


@sql("win_latest_snapshot", "select file_path, id, content_hash from snapshots qualify row_number() over (partition by file_path order by created_at desc, id desc) = 1")
def win_latest_snapshot(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    return s.groupBy("file_path").agg(F.max_by(F.struct("id", "content_hash"), F.struct("created_at", "id")).alias("x")).select("file_path", "x.*")


@sql("win_prev_change", "select id, max(created_at) over (partition by file_path order by epoch_us(created_at) range between unbounded preceding and 1 preceding) as previous from changelog")
def win_prev_change(spark, sf_dir):
    """The last strictly earlier change of the file."""
    c = changelog(spark, sf_dir).select("id", "file_path", "created_at", F.unix_micros(F.col("created_at").cast("timestamp")).alias("us"))
    w = Window.partitionBy("file_path").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    return c.select("id", F.max("created_at").over(w).alias("previous"))


@sql("win_record_select", """with c as (select id, case when id % 97 = 0 then '  ' else file_path end as identity, case when id % 5 = 0 then 'missing' when id % 5 = 1 then 'unknown' else 'current' end as state,
  commit_sha as indexed, case when id % 7 = 0 then 'other' else commit_sha end as now, (id % 11) / 10.0::double as completeness, created_at from changelog),
q as (select *, case when state = 'missing' then 'historical' when indexed is not null and now is not null and indexed <> now then 'stale_advisory' when state = 'current' and indexed is not null and now is not null then 'current' else 'unverified' end as quality from c),
r as (select *, case when trim(identity) = '' then 'invalid_identity' when state = 'missing' then 'missing_current_source' when quality = 'stale_advisory' then 'stale_hash' end as why from q),
k as (select *, row_number() over (partition by identity, why is null order by case quality when 'current' then 0 else 1 end, case state when 'current' then 0 else 1 end, least(1, completeness) desc, created_at desc, id) as place from r)
select id, trim(identity) as identity, quality, coalesce(why, case when place > 1 then 'duplicate_lower_quality' end) as reason from k""")
def win_record_select(spark, sf_dir):
    """One record for each identity; what is left out keeps the reason why."""
    i = F.col("id")
    c = changelog(spark, sf_dir).select(
        "id", F.when(i % 97 == 0, "  ").otherwise(F.col("file_path")).alias("identity"), F.when(i % 5 == 0, "missing").when(i % 5 == 1, "unknown").otherwise("current").alias("path_state"),
        F.col("commit_sha").alias("indexed_hash"), F.when(i % 7 == 0, "other").otherwise(F.col("commit_sha")).alias("current_hash"), ((i % 11) / 10.0).alias("completeness"), F.col("created_at").alias("indexed_at"),
    )
    return S.select_records(c, "id").select("id", "identity", "quality", "reason")


@sql("win_verify_lastN", "select id, case when row_number() over (partition by file_path order by id desc) <= 3 then 'verified' else verification_status end as status from changelog")
def win_verify_lastN(spark, sf_dir):
    w = Window.partitionBy("file_path").orderBy(F.desc("id"))
    return changelog(spark, sf_dir).select("id", F.when(F.row_number().over(w) <= 3, "verified").otherwise(F.col("verification_status")).alias("status"))


WITNESS = "case event_type when 'view' then 2 when 'click' then 1 when 'purchase' then 12 when 'signup' then 7 else 4 end"


@sql("win_witness_rank", f"""with w as (select user_id, event_type, least(100, sum({WITNESS}))::double as confidence, max(ts) as seen, arg_max(event_type, (ts, event_id)) as last from events group by user_id, event_type)
select user_id, event_type, round(greatest(0, 30 - date_diff('second', seen, timestamp '2024-02-01') / 86400.0) + 3 * {WITNESS.replace('event_type', 'last')} + 8 * ln(1 + confidence), 6) as score from w order by score desc, user_id, event_type limit 20""")
def win_witness_rank(spark, sf_dir):
    e = table(spark, sf_dir, "events")

    def weight(c):
        return F.when(F.col(c) == "view", 2).when(F.col(c) == "click", 1).when(F.col(c) == "purchase", 12).when(F.col(c) == "signup", 7).otherwise(4)

    w = e.groupBy("user_id", "event_type").agg(F.least(F.lit(100), F.sum(weight("event_type"))).cast("double").alias("confidence"), F.max("ts").alias("seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    age = (F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_timestamp("seen")) / 86400.0
    score = F.greatest(F.lit(0.0), 30 - age) + 3 * weight("last") + 8 * F.log1p("confidence")
    return w.select("user_id", "event_type", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "user_id", "event_type").limit(20)


@sql("win_normalise_max", "select file_id, round(greatest(0, least(1, loc::double / max(loc) over ())), 6) as share from files")
def win_normalise_max(spark, sf_dir):
    """Divided by the maximum of all, which is one aggregated row."""
    f = files(spark, sf_dir).select("file_id", "loc")
    return f.join(F.broadcast(f.agg(F.max("loc").alias("m")))).select("file_id", F.round(F.greatest(F.lit(0), F.least(F.lit(1), F.col("loc") / F.col("m"))), 6).alias("share"))


@sql("win_char_budget", "with i as (select file_path, length('{\"file_path\":\"' || file_path || '\",\"loc\":' || loc || '}') + 1 as cost from files where workspace = 'ws1' order by file_path limit 200) select file_path from (select *, sum(cost) over (order by file_path) + 1 as upto from i) where upto <= 5000")
def win_char_budget(spark, sf_dir):
    """The longest prefix of a bounded list whose JSON array fits a budget."""
    items = files(spark, sf_dir).where("workspace = 'ws1'").select("file_path", "loc").orderBy("file_path").limit(200)
    cost = F.char_length(F.to_json(F.struct("file_path", "loc"), {"ignoreNullFields": "false"})) + 1
    upto = F.sum(cost).over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, 0)) + 1
    return items.withColumn("upto", upto).where("upto <= 5000").select("file_path")


@sql("win_split_limit", "with n as (select p_partkey, p_size as total, p_partkey % 19 + 1 as sources from part) select p_partkey, k::int as source, (total // sources + case when k < total % sources then 1 else 0 end)::bigint as share from n, range(20) u(k) where k < sources")
def win_split_limit(spark, sf_dir):
    """Each part's size as a limit, split over one to nineteen sources; the first ones take the remainder."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("total"), (F.col("p_partkey") % 19 + 1).alias("sources"))
    rows = rows.withColumn("source", F.explode(F.sequence(F.lit(0), (F.col("sources") - 1).cast("int"))))
    share = F.floor(F.col("total") / F.col("sources")) + F.when(F.col("source") < F.col("total") % F.col("sources"), 1).otherwise(0)
    return rows.select("p_partkey", "source", share.cast("long").alias("share"))


@sql("win_edge_cap", "select target, string_agg(source, ',' order by source) as kept from (select * from import_edges qualify row_number() over (partition by target order by source) <= 2) group by target")
def win_edge_cap(spark, sf_dir):
    """At most so many edges of each aggregate."""
    w = Window.partitionBy("target").orderBy("source")
    top = import_edges(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return top.groupBy("target").agg(F.array_join(F.sort_array(F.collect_list("source")), ",").alias("kept"))


@sql("lim_page", "select id, created_at from changelog order by created_at desc, id desc limit 20 offset 40")
def lim_page(spark, sf_dir):
    return changelog(spark, sf_dir).select("id", "created_at").orderBy(F.desc("created_at"), F.desc("id")).offset(40).limit(20)


@sql("lim_scan", "select count(*)::bigint as rows, count(*) > 5000 as partial from (select * from changelog limit 5001)")
def lim_scan(spark, sf_dir):
    """A safety bound that tells whether it cut."""
    return changelog(spark, sf_dir).select("id").limit(5001).agg(F.count("*").alias("rows"), (F.count("*") > 5000).alias("partial"))


@sql("lim_result_bounds", "select file_path, len(list_distinct(string_split(text, ' '))[1:100])::int as words from files order by file_path limit 500")
def lim_result_bounds(spark, sf_dir):
    return files(spark, sf_dir).select("file_path", F.size(F.slice(F.array_distinct(F.split("text", " ")), 1, 100)).alias("words")).orderBy("file_path").limit(500)


@sql("lim_char_bound", "select file_id, case when length(text) <= 80 then text else substr(text, 1, 79) || '…' end as text from files")
def lim_char_bound(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", clamp_text(F.col("text"), 80).alias("text"))


@sql("sort_edges", "select source, target, edge_type from all_edges order by source, target, edge_type limit 300")
def sort_edges(spark, sf_dir):
    return all_edges(spark, sf_dir).select("source", "target", "edge_type").orderBy("source", "target", "edge_type").limit(300)


@sql("set_union_edges", "select source, target, edge_type, usage_count, round(confidence, 4) as confidence, provenance from all_edges")
def set_union_edges(spark, sf_dir):
    return all_edges(spark, sf_dir).withColumn("confidence", F.round("confidence", 4))


@sql("set_distinct_lists", "select p_brand, array_to_string(list_sort(list_distinct(list(p_type))), ',') as types from part group by p_brand")
def set_distinct_lists(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@sql("set_neighbors", "select source as node, target as neighbor from all_edges union select target, source from all_edges")
def set_neighbors(spark, sf_dir):
    e = all_edges(spark, sf_dir)
    return e.select(F.inline(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("neighbor")), F.struct(F.col("target").alias("node"), F.col("source").alias("neighbor"))))).distinct()


@sql("set_hazard_sync", """with r as (select file_id, hazards, case when file_id % 2 = 0 then ['toxic', 'r' || (file_id % 4), ' x '] else ['r1'] end as ranged from files)
select file_id, array_to_string(list_concat(hazards, list_filter(list_transform(ranged, lambda x: trim(x)), lambda x: not list_contains(hazards, x))), ',') as hazards,
  len(list_filter(list_transform(ranged, lambda x: trim(x)), lambda x: not list_contains(hazards, x)))::int as added from r""")
def set_hazard_sync(spark, sf_dir):
    """Both lists in one: originals first, then what only the ranged list has."""
    ranged = F.when(F.col("file_id") % 2 == 0, F.array(F.lit("toxic"), F.concat(F.lit("r"), (F.col("file_id") % 4).cast("string")), F.lit(" x "))).otherwise(F.array(F.lit("r1")))
    f = files(spark, sf_dir).select("file_id", "hazards", F.transform(ranged, lambda x: F.trim(x)).alias("ranged"))
    extra = F.array_except("ranged", "hazards")
    return f.select("file_id", F.array_join(F.concat("hazards", extra), ",").alias("hazards"), F.size(extra).alias("added"))


@sql("set_witness_merge", "with t as (select user_id, event_type, ts, event_id, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r1 from events), d as (select * from t where r1 = 1) select user_id, string_agg(event_type, ',' order by ts desc, event_id desc) as evidence from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from d) where rn <= 3 group by user_id")
def set_witness_merge(spark, sf_dir):
    """The newest evidence of each kind, newest first, at most three."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("at"))
    listed = last.groupBy("user_id").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("at", "event_type")))), 1, 3).alias("x"))
    return listed.select("user_id", F.array_join(F.transform("x", lambda r: r["event_type"]), ",").alias("evidence"))


@sql("act_history", """with h as (select * from changelog where workspace = 'ws1' and cluster = 'error'),
entries as (select 'entries' as mode, id::varchar as key, 1::bigint as n from h order by created_at desc, id desc limit 20),
timeline as (select 'timeline' as mode, strftime(created_at, '%Y-%m-%d') as key, count(*)::bigint as n from h group by 2),
grouped as (select 'group' as mode, coalesce(author_name, '(none)') as key, count(*)::bigint as n from h group by 2 order by n desc, key limit 20)
select * from entries union all select 'count', 'all', count(*)::bigint from h union all select * from timeline union all select * from grouped""")
def act_history(spark, sf_dir):
    """The four modes of a history request under one filter: entries, count, timeline, group."""
    h = changelog(spark, sf_dir).where("workspace = 'ws1' and cluster = 'error'")
    entries = h.orderBy(F.desc("created_at"), F.desc("id")).limit(20).select(F.lit("entries").alias("mode"), F.col("id").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))
    count = h.agg(F.count("*").alias("n")).select(F.lit("count").alias("mode"), F.lit("all").alias("key"), "n")
    timeline = h.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("key")).agg(F.count("*").alias("n")).select(F.lit("timeline").alias("mode"), "key", "n")
    grouped = h.groupBy(F.coalesce("author_name", F.lit("(none)")).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(20).select(F.lit("group").alias("mode"), "key", "n")
    return entries.unionByName(count).unionByName(timeline).unionByName(grouped)


@sql("symbol_kinds", "select symbol_id, case when lower(raw_kind) in ('function','class','type','interface','const','enum','namespace','re-export','value','default') then lower(raw_kind) else 'unknown' end as kind, sha1(file_path || ':' || name || ':' || raw_kind) as signature_hash from symbols")
def symbol_kinds(spark, sf_dir):
    return symbols(spark, sf_dir).select("symbol_id", M.symbol_kind(F.col("raw_kind")).alias("kind"), F.sha1(F.concat_ws(":", "file_path", "name", "raw_kind")).alias("signature_hash"))


@sql("g_path_cluster", "select file_id, case when file_id % 5 = 0 then 'ui-' || cluster when file_id % 5 = 1 then 'misc-lib' when file_id % 5 = 2 then 'core' when file_id % 5 = 3 then 'api-' || language else 'docs' end as cluster from files where cluster is not null")
def g_path_cluster(spark, sf_dir):
    i = F.col("file_id")
    path = F.when(i % 5 == 0, F.concat(F.lit("src/components/"), "cluster", F.lit("/a.ts"))).when(i % 5 == 1, F.lit("lib/a/b.ts")).when(i % 5 == 2, F.lit("src/a.ts")).when(i % 5 == 3, F.concat(F.lit("src/app/api/"), "language", F.lit("/r.ts"))).otherwise(F.lit("src/a/b/readme.md"))
    return files(spark, sf_dir).where("cluster is not null").select("file_id", M.path_cluster(path).alias("cluster"))
