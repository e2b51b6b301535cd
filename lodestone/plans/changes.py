"""Registered queries: writes, commits, versions, diffs, streams."""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..embedding import Space, back_fill, embed
from ..operators import commits as K
from ..operators import diff as D
from ..operators import graph as G
from ..operators import store as S
from ..sources.adapters import changelog, files, import_edges, references, snapshots, symbols, table, vectors, with_views
from ..payloads import normalise_commit
from ..planning import work_limits
from ..operators.search_index import SearchIndex
from ..shared import new_folder, shared_dir
from ..streaming import changes as C
from ..streaming.debounce import debounced, deliver
from .registry import query
from .retrieval import DOCUMENTS, FOLD, documents


def sql(key, statement):
    return query(key, with_views(statement))


def scratch(spark, name):
    """A folder of its own in the shared directory."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def records(spark, sf_dir):
    return files(spark, sf_dir).select("file_path", "file_hash", "loc", "blurb", "extraction_model", "file_id")


REC = "r as (select file_path, file_hash, loc, blurb, extraction_model, file_id from files)"


@sql("sink_files_upsert", f"with {REC} select file_path, case when file_id % 5 = 0 then 'new' else blurb end as blurb from r where file_id % 3 <> 0 or file_id % 5 = 0")
def sink_files_upsert(spark, sf_dir):
    """Through a versioned table: written, upserted, read back."""
    r = records(spark, sf_dir)
    t = S.Table(spark, scratch(spark, "files"), ["file_path"])
    t.write(r.where("file_id % 3 <> 0").select("file_path", "blurb"))
    t.upsert(r.where("file_id % 5 = 0").select("file_path", F.lit("new").alias("blurb")))
    return t.read()


@sql("sink_scan_upsert", f"with {REC} select file_path, case when file_id % 7 = 0 then 'changed' else file_hash end as file_hash, case when file_id % 7 = 0 then loc + 1 else loc end as loc, blurb, case when file_id % 7 = 0 then null else extraction_model end as extraction_model from r")
def sink_scan_upsert(spark, sf_dir):
    """A scan keeps what people wrote and clears what was derived from other contents."""
    r = records(spark, sf_dir).drop("file_id")
    hot = records(spark, sf_dir)
    scan = hot.select("file_path", F.when(F.col("file_id") % 7 == 0, "changed").otherwise(F.col("file_hash")).alias("file_hash"), F.when(F.col("file_id") % 7 == 0, F.col("loc") + 1).otherwise(F.col("loc")).alias("loc"))
    return S.merge_scan(r, scan, ["file_path"], "file_hash", ["extraction_model"])


@sql("sink_edges_replace", "select source, target from import_edges where substr(source, 12) not in ('1', '2') union all select source, 'part_000000' from (select distinct source from import_edges) where substr(source, 12) = '1'")
def sink_edges_replace(spark, sf_dir):
    e = import_edges(spark, sf_dir)
    scope = e.where(F.substring("source", 12, 9).isin("1", "2")).select("source").distinct()
    incoming = scope.where(F.substring("source", 12, 9) == "1").select("source", F.lit("part_000000").alias("target"))
    return S.replace_for(e, incoming, "source", scope)


@sql("sink_symbols_replace", "select name, raw_kind, min(symbol_id) as symbol_id from symbols where trim(name) <> '' group by all")
def sink_symbols_replace(spark, sf_dir):
    """One symbol for each name and kind, the first of them."""
    s = symbols(spark, sf_dir).where("trim(name) <> ''").select("name", "raw_kind", "symbol_id")
    return S.first_wins(s, ["name", "raw_kind"], "symbol_id")


@sql("sink_refs_replace", """with u as (select i.source, i.target, s.symbol_id as target_symbol_id, case when s.symbol_id % 3 = 0 then 'heuristic' else 'model-x' end as model, 1 + s.symbol_id % 4 as uses, i.source in (select target from refs where edge_type = 'CALLS') as scoped from import_edges i join symbols s on s.file_path = i.target)
select source, target, edge_type, usage_count, round(confidence, 4) as confidence, 'ast' as provenance from refs where edge_type = 'CALLS' or target not in (select file_path from symbols where symbol_id % 2 = 0)
union all select target, source, 'runtime_call', uses, case model when 'heuristic' then 0.6 else 0.8 end, case model when 'heuristic' then 'inferred' else 'llm' end from u where target_symbol_id % 2 = 0""")
def sink_refs_replace(spark, sf_dir):
    """The derived references of the files in scope are replaced, parsed ones stay. A derived reference goes
    from the file that defines a symbol to the one that uses it; a model other than the heuristic is
    provenance ``llm`` with confidence 0.8, the heuristic ``inferred`` with 0.6."""
    s = symbols(spark, sf_dir).select("symbol_id", F.col("file_path").alias("defined"))
    r = references(spark, sf_dir).select("source", "target", "edge_type", "usage_count", F.round("confidence", 4).alias("confidence"), F.lit("ast").alias("provenance"))
    scope = s.where("symbol_id % 2 = 0").select(F.col("defined").alias("target"))
    stays = r.where("edge_type = 'CALLS'").unionByName(r.where("edge_type <> 'CALLS'").join(scope, "target", "left_anti").select(*r.columns))
    uses = import_edges(spark, sf_dir).join(s, F.col("target") == F.col("defined")).where("symbol_id % 2 = 0")
    heuristic = F.col("symbol_id") % 3 == 0
    derived = uses.select(F.col("defined").alias("source"), F.col("source").alias("target"), F.lit("runtime_call").alias("edge_type"), (1 + F.col("symbol_id") % 4).alias("usage_count"), F.when(heuristic, 0.6).otherwise(0.8).alias("confidence"), F.when(heuristic, "inferred").otherwise("llm").alias("provenance"))
    return stays.unionByName(derived)


@sql("sink_delete_file", f"""with {DOCUMENTS}, gone as (select file_path as p, symbol_id as n from symbols where symbol_id % 10 = 0), kept_docs as (select doc_id from documents where doc_id not in (select n from gone))
select 'import_edges' as kept, count(*)::bigint as n from import_edges where source not in (select p from gone) and target not in (select p from gone)
union all select 'refs', count(*)::bigint from refs where source not in (select p from gone) and target not in (select p from gone)
union all select 'symbols', count(*)::bigint from symbols where file_path not in (select p from gone)
union all select 'vectors', count(*)::bigint from vectors where vec_id not in (select n from gone)
union all select 'chunks', sum(len(string_split(text, chr(10))))::bigint from documents where doc_id in (select * from kept_docs)
union all select 'postings', sum(len(list_distinct({FOLD.format('document')})))::bigint from docs where file_id in (select * from kept_docs)
union all select 'files', count(*)::bigint from kept_docs""")
def sink_delete_file(spark, sf_dir):
    """Deleted files take with them their edges at either end, symbols, vectors, chunks, postings of the search
    index and rows: what is left of each table."""
    s = symbols(spark, sf_dir)
    gone = s.where("symbol_id % 10 = 0").select(F.col("file_path").alias("key"))
    numbers = s.where("symbol_id % 10 = 0").select(F.col("symbol_id").alias("key"))
    chunks = files(spark, sf_dir).select("file_id", F.explode(F.split("text", "\n")).alias("chunk"))
    tables = {
        "import_edges": (import_edges(spark, sf_dir), gone, ("source", "target")), "refs": (references(spark, sf_dir), gone, ("source", "target")), "symbols": (s, gone, ("file_path",)),
        "vectors": (vectors(spark, sf_dir), numbers, ("vec_id",)), "chunks": (chunks, numbers, ("file_id",)), "files": (files(spark, sf_dir).select("file_id"), numbers, ("file_id",)),
    }
    index = SearchIndex(spark, new_folder(spark, "cascade-index"))
    index.upsert(documents(spark, sf_dir), "file_id", F.col("document"))
    index.delete(numbers)
    tables["postings"] = index.postings(), numbers, ()
    left = [S.delete_keys(t, g, *columns).agg(F.count("*").alias("n")).select(F.lit(name).alias("kept"), "n") for name, (t, g, columns) in tables.items()]
    return reduce(DataFrame.unionByName, left)


@sql("sink_chunks", "select file_id, pos::int as pos, sha1(chunk) as text_hash from (select file_id, unnest(range(0, len(string_split(text, chr(10))))) as pos, unnest(string_split(text, chr(10))) as chunk from files)")
def sink_chunks(spark, sf_dir):
    """Source chunks, a line each, with the hash that tells whether they must be embedded again."""
    return files(spark, sf_dir).select("file_id", F.posexplode(F.split("text", "\n")).alias("pos", "chunk")).select("file_id", "pos", F.sha1("chunk").alias("text_hash"))


@sql("sink_snapshot", "with v as (select id, file_path, created_at, sha256((length(content) % 2)::varchar) as h from snapshots), l as (select *, lag(h) over (partition by file_path order by created_at, id) as b from v) select id from l where b is distinct from h")
def sink_snapshot(spark, sf_dir):
    """A version is stored unless it equals the one before."""
    v = snapshots(spark, sf_dir).select("id", "file_path", "created_at", F.sha2((F.length("content") % 2).cast("string"), 256).alias("h"))
    return S.append_changed(v, "file_path", ["created_at", "id"], "h").select("id")


#: Commits of two files in three: what each gives, and the version it expects: that of its record, a wrong one, or none.
VERSION_SQL = """'sha256:' || sha256(to_json({'blurb': coalesce(blurb, ''), 'cluster': cluster, 'conventions': coalesce(conventions, []), 'dataFlows': coalesce(data_flows, []), 'fileHash': file_hash, 'filePath': file_path, 'hazards': coalesce(hazards, []), 'keyTypes': coalesce(key_types, []),
  'patterns': coalesce(patterns, []), 'publicApi': coalesce(exports, []), 'purpose': coalesce(purpose, ''), 'rangedHazards': []::varchar[], 'sourceHighlights': coalesce(source_highlights, []), 'tags': coalesce(tags, []), 'workspace': workspace})::varchar)"""
COMMITS = f"""known as (select *, {VERSION_SQL} as current from files),
came as (select file_id as number, workspace, file_path, 'change ' || file_id as summary, case when file_id % 6 = 0 then ' purpose ' || file_id || ' ' end as purpose, case when file_id % 4 = 0 then 'blurb' end as blurb, case when file_id % 10 = 0 then 'new cluster' end as cluster,
  case when file_id % 5 = 0 then ['t', 'x' || file_id] end as tags, case when file_id % 8 = 0 then ['risk'] end as hazards, case when file_id % 12 = 0 then ['verified-external'] when file_id % 9 = 0 then ['asserted'] else []::varchar[] end as evidence,
  case when file_id % 7 = 1 then current when file_id % 7 = 2 then 'sha256:other' end as expected from known where file_id % 3 <> 1),
merged as (select c.number, c.summary, c.expected, c.evidence, k.current, k.workspace, k.file_path, k.file_hash, coalesce(trim(c.purpose), k.purpose) as purpose, coalesce(c.blurb, k.blurb) as blurb, coalesce(c.cluster, k.cluster) as cluster, coalesce(c.tags, k.tags) as tags, coalesce(c.hazards, k.hazards) as hazards,
  k.conventions, k.data_flows, k.key_types, k.patterns, k.exports, k.source_highlights,
  list_filter(['changelog', case when len(c.evidence) > 0 then 'evidence' end, case when c.purpose is not null then 'purpose' end, case when c.blurb is not null then 'blurb' end, case when c.cluster is not null then 'cluster' end, case when c.tags is not null then 'tags' end, case when c.hazards is not null then 'hazards' end], lambda x: x is not null) as updated
  from came c join known k using (file_path)),
judged as (select *, list_filter([case when trim(coalesce(purpose, '')) = '' then 'purpose' end, case when trim(coalesce(blurb, '')) = '' then 'blurb' end, case when len(tags) = 0 then 'tags' end, case when len(source_highlights) = 0 then 'sourceHighlights' end], lambda x: x is not null) as missing,
  {VERSION_SQL} as new from merged),
told as (select *, case when expected is not null and expected <> current then 'conflict' when len(missing) > 0 then 'rejected' else 'committed' end as status from judged)"""


def stored_files(spark, sf_dir):
    f = files(spark, sf_dir).withColumnRenamed("exports", "public_api").withColumn("ranged_hazards", F.array().cast("array<string>"))
    return f.select("workspace", "file_path", "file_hash", "ranged_hazards", *K.TEXTS, *K.LISTS)


def commits(spark, sf_dir):
    f, i = files(spark, sf_dir).where("file_id % 3 <> 1"), F.col("file_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    own = stored_files(spark, sf_dir).select("file_path", K.version().alias("current"))
    given = {"purpose": F.when(i % 6 == 0, text(" purpose ", i, " ")), "blurb": F.when(i % 4 == 0, "blurb"), "cluster": F.when(i % 10 == 0, "new cluster"), "tags": F.when(i % 5 == 0, F.array(F.lit("t"), text("x", i))), "hazards": F.when(i % 8 == 0, F.array(F.lit("risk")))}
    kinds = dict(stored_files(spark, sf_dir).dtypes)
    rest = [F.lit(None).cast(kinds[c]).alias(c) for c in (*K.TEXTS, *K.LISTS) if c not in given]
    evidence = F.when(i % 12 == 0, F.array(F.lit("verified-external"))).when(i % 9 == 0, F.array(F.lit("asserted"))).otherwise(F.array().cast("array<string>"))
    expected = F.when(i % 7 == 1, F.col("current")).when(i % 7 == 2, "sha256:other")
    return f.join(own, "file_path").select(i.alias("number"), "workspace", "file_path", text("change ", i).alias("summary"), *[c.alias(k) for k, c in given.items()], *rest, evidence.alias("evidence"), expected.alias("expected"))


@sql("cmd_commit", f"with {COMMITS} select file_path, status, array_to_string(missing, ',') as missing, array_to_string(list_sort(updated), ',') as updated, case when status = 'committed' then new else current end as version, case when list_contains(evidence, 'verified-external') then 'verified' else 'pending' end as verification from told")
def cmd_commit(spark, sf_dir):
    """A batch of commits: merged field by field, checked against the version they expect and for what a record
    must have."""
    found = K.judge(stored_files(spark, sf_dir), commits(spark, sf_dir))
    return found.select("file_path", "status", F.array_join("missing", ",").alias("missing"), F.array_join("updated", ",").alias("updated"), "version", "verification")


@sql("cmd_commit_records", f"""with {COMMITS}
select file_path, 'record' as kind, 0::bigint as number, case when status = 'committed' then new else k.current end as version from known k left join (select file_path, status, new from told) t using (file_path)
union all select file_path, 'history', number, new from told where status = 'committed'""")
def cmd_commit_records(spark, sf_dir):
    """Records and history after a batch of commits was applied, twice: the second time changes nothing."""
    records, log = S.Table(spark, scratch(spark, "records"), ["workspace", "file_path"]), S.Table(spark, scratch(spark, "history"))
    records.write(stored_files(spark, sf_dir))
    for _ in range(2):
        K.commit(records, log, commits(spark, sf_dir), ("commits", 1))
    rows = records.read().select("file_path", F.lit("record").alias("kind"), F.lit(0).cast("long").alias("number"), K.version().alias("version"))
    return rows.unionByName(log.read().select("file_path", F.lit("history").alias("kind"), "number", "version"))


@sql("cmd_commit_batch_idem", "select event_id as key, case when event_id % 3 <> 0 then 'fresh' when event_id % 6 = 0 then 'conflict' else 'replayed' end as status from events where event_id % 2 = 0 or event_id % 3 = 0")
def cmd_commit_batch_idem(spark, sf_dir):
    """Same key and payload: replayed; same key, other payload: conflict."""
    e = table(spark, sf_dir, "events")
    payload = F.sha2(F.col("event_type"), 256)
    commands = e.where("event_id % 2 = 0 or event_id % 3 = 0").select(F.col("event_id").alias("key"), payload.alias("payload_hash"))
    done = e.where("event_id % 3 = 0").select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 6 == 0, "other").otherwise(payload).alias("payload_hash"))
    return S.replay(commands, done).select("key", "status")


@sql("plan_budget", """with a(k, action, node, edge, fan) as (values (0, 'cycles', 3, 1, 2), (1, 'audit:gaps', 4, 1, 2), (2, 'audit:smells', 5, 2, 3), (3, 'audit:hotspots', 4, 2, 3), (4, 'search', 3, 1, 2)),
p as (select p_partkey, action, node, edge, fan, least(100000, greatest(1, p_partkey * 613 % 130000)) as units from part join a on k = p_partkey % 5)
select p_partkey, action, units::bigint as units, (units // (node + edge * fan))::bigint as node_limit, (units // (node + edge * fan) * fan)::bigint as edge_limit, (units // (node + edge * fan) * (node + edge * fan))::bigint as planned from p""")
def plan_budget(spark, sf_dir):
    """Node and edge limits of requests, one for each part, under budgets of work units."""
    k = F.col("p_partkey")
    action = F.element_at(F.array(*map(F.lit, ("cycles", "audit:gaps", "audit:smells", "audit:hotspots", "search"))), (k % 5 + 1).cast("int"))
    asked = table(spark, sf_dir, "part").select("p_partkey", action.alias("action"), (k * 613 % 130000).alias("asked"))
    return asked.select("p_partkey", "action", *work_limits(F.col("action"), F.col("asked")))


@sql("cmd_commit_legacy", """select p_partkey as id, 'src/' || p_partkey || '.ts' as file_path, 'why ' || p_name as changelog_entry, 'why ' || p_name as summary,
  case when p_partkey % 2 = 0 then p_brand || '|' || p_type else 'one|two|three' end as tags, p_partkey % 3 = 0 as breaking_changes, case when p_partkey % 4 = 0 then 'run:function' else 'go:value|stop:value' end as public_api from part""")
def cmd_commit_legacy(spark, sf_dir):
    """Loose payloads in their proper form: aliases, JSON in strings, comma and bullet lists, words for truth."""
    k = F.col("p_partkey")
    payload = F.to_json(F.struct(
        k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit(" src/"), k.cast("string"), F.lit(".ts "))).alias("filePath"), F.when(k % 2 == 1, F.concat(F.lit("src/"), k.cast("string"), F.lit(".ts"))).alias("path"),
        F.concat(F.lit("why "), "p_name", F.lit(" ")).alias("rationale"), F.when(k % 2 == 0, F.to_json(F.array("p_brand", "p_type"))).otherwise("- one\n* two, three,").alias("tags"),
        F.when(k % 3 == 0, "Yes").otherwise("no").alias("breakingChanges"), F.when(k % 4 == 0, '[{"symbol": "run", "kind": "function"}, {"kind": "nameless"}]').otherwise("go, stop").alias("publicApi"), F.lit("x").alias("unknown"),
    ))

    def run(parts):
        for part in parts:
            rows = []
            for text in part.column("payload").to_pylist():
                raw = json.loads(text)
                c = normalise_commit(raw)
                rows.append((raw["id"], c["file_path"], c["changelog_entry"], c["summary"], "|".join(c["tags"]), c["breaking_changes"], "|".join(f"{e['name']}:{e['type']}" for e in c["public_api"])))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["id", "file_path", "changelog_entry", "summary", "tags", "breaking_changes", "public_api"])

    out = "id bigint, file_path string, changelog_entry string, summary string, tags string, breaking_changes boolean, public_api string"
    return table(spark, sf_dir, "part").select(payload.alias("payload")).mapInArrow(run, out)


def hashed_vectors():
    """A provider without a model: vectors of length 1 from digests, for tests."""

    def vectors(texts):
        rows = [np.frombuffer(hashlib.sha256(t.encode()).digest(), np.uint8).astype(float) - 127.5 for t in texts]
        return [(r / np.linalg.norm(r)).tolist() for r in rows]

    return vectors


@sql("emb_backfill", "select file_id as id, sha256(case when file_id % 5 = 0 then blurb || '!' else blurb end) as text_hash, case when file_id % 5 <> 0 and file_id % 7 <> 0 then 'kept' else 'embedded' end as state from files where blurb is not null")
def emb_backfill(spark, sf_dir):
    """Blurbs that changed or never had a vector are embedded, the others keep theirs."""
    space = Space("tests", "digest", 32)
    f = files(spark, sf_dir).select(F.col("file_id").alias("id"), F.col("blurb").alias("text"))
    stored = embed(f.where("id % 7 <> 0"), hashed_vectors, space).withColumn("vector", F.transform("vector", lambda x: x * 0))
    now = f.withColumn("text", F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    out = back_fill(now, stored, hashed_vectors, space)
    return out.select("id", "text_hash", F.when(F.forall("vector", lambda x: x == 0), "kept").otherwise("embedded").alias("state"))


@sql("cmd_memory", "select verification_status as category, count(*)::bigint as n from (select * from changelog where id % 2 = 0 union all select * from changelog where id % 5 = 0) group by 1")
def cmd_memory(spark, sf_dir):
    """Append-only."""
    c = changelog(spark, sf_dir)
    return c.where("id % 2 = 0").unionByName(c.where("id % 5 = 0")).groupBy(F.col("verification_status").alias("category")).agg(F.count("*").alias("n"))


@sql("cmd_symbol_identity", "select file_path, name, case when symbol_id % 4 = 0 then 'new' else 'old' end as purpose from symbols where symbol_id % 3 = 0 or symbol_id % 4 = 0")
def cmd_symbol_identity(spark, sf_dir):
    """By the symbol's number: several may share a path and a name, since paths hold six digits of a number."""
    s = symbols(spark, sf_dir).select("symbol_id", "file_path", "name")
    old = s.where("symbol_id % 3 = 0").withColumn("purpose", F.lit("old"))
    return S.upsert(old, s.where("symbol_id % 4 = 0").withColumn("purpose", F.lit("new")), ["symbol_id"]).drop("symbol_id")


@sql("cmd_admin", "select 'ws' || k as workspace, (select count(*) from files where workspace = 'ws' || k)::bigint as files, (select count(*) from changelog where workspace = 'ws' || k)::bigint as changes from range(3) t(k)")
def cmd_admin(spark, sf_dir):
    """The list of workspaces with what they hold."""
    f = files(spark, sf_dir).groupBy("workspace").agg(F.count("*").alias("files"))
    return f.join(changelog(spark, sf_dir).groupBy("workspace").agg(F.count("*").alias("changes")), "workspace", "full").na.fill(0)


@sql("chg_insert", "select count(*)::bigint as n, max(id) as last from (select id from changelog union all select id + 1000000 from changelog where breaking_changes)")
def chg_insert(spark, sf_dir):
    c = changelog(spark, sf_dir).select("id", "breaking_changes")
    return c.unionByName(c.where("breaking_changes").withColumn("id", F.col("id") + 1000000)).agg(F.count("*").alias("n"), F.max("id").alias("last"))


@sql("chg_verify", "select id, case when id % 50 = 0 then 'verified' else verification_status end as status from changelog")
def chg_verify(spark, sf_dir):
    c = changelog(spark, sf_dir)
    ids = c.where("id % 50 = 0").select("id", F.lit(True).alias("hit"))
    return c.join(ids, "id", "left").select("id", F.when(F.col("hit"), "verified").otherwise(F.col("verification_status")).alias("status"))


@sql("chg_stamp", "select id, coalesce(commit_sha, 'abc') as commit_sha from changelog")
def chg_stamp(spark, sf_dir):
    """A stamp goes only where there is none."""
    return changelog(spark, sf_dir).select("id", F.coalesce("commit_sha", F.lit("abc")).alias("commit_sha"))


@sql("chg_author_backfill", "with k as (select author_instance_id, min(author_name) as name from changelog where author_name is not null group by 1) select c.id, coalesce(c.author_name, k.name) as author_name from changelog c left join k using (author_instance_id)")
def chg_author_backfill(spark, sf_dir):
    c = changelog(spark, sf_dir)
    known = c.where("author_name is not null").groupBy("author_instance_id").agg(F.min("author_name").alias("name"))
    return c.join(known, "author_instance_id", "left").select("id", F.coalesce("author_name", "name").alias("author_name"))


WEIGHTS = {"view": 2, "click": 1, "purchase": 12, "signup": 7, "error": 4}
WEIGHT_SQL = "case event_type " + " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.items()) + " else 1 end"


@sql("wit_record", f"select user_id, event_type, count(*)::bigint as n, least(100, sum({WEIGHT_SQL}))::bigint as confidence, max(ts) as last_seen from events group by all")
def wit_record(spark, sf_dir):
    return C.witness(table(spark, sf_dir, "events"), WEIGHTS)


@sql("wit_list", f"select user_id, event_type, confidence from (select user_id, event_type, least(100, sum({WEIGHT_SQL}))::bigint as confidence from events group by all) order by confidence desc, user_id, event_type limit 20")
def wit_list(spark, sf_dir):
    return C.witness(table(spark, sf_dir, "events"), WEIGHTS).select("user_id", "event_type", "confidence").orderBy(F.desc("confidence"), "user_id", "event_type").limit(20)


@sql("heal_highlights", "select p_brand, count(*)::bigint as kept, max(p_size) as widest from part where p_size % 4 <> 0 group by p_brand")
def heal_highlights(spark, sf_dir):
    """Malformed ranges go, the others are numbered anew."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct(F.col("p_size").alias("end"), (F.col("p_size") % 4).alias("start")))).alias("h"))
    healed = F.transform(F.filter("h", lambda x: x["start"] != 0), lambda x, k: F.struct((k + 1).alias("id"), x["end"].alias("end")))
    return p.select("p_brand", F.size(healed).cast("long").alias("kept"), F.array_max(F.transform(healed, lambda x: x["end"])).alias("widest"))


@sql("ctx_resource", "select cluster, count(*)::bigint as files from files where cluster is not null group by 1 order by files desc, cluster limit 5")
def ctx_resource(spark, sf_dir):
    return files(spark, sf_dir).where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "cluster").limit(5)


# --- versions and diffs --------------------------------------------------------------------------------


ENDPOINTS = """ends as (
  select 'id' as endpoint, file_path, id, content from snapshots where id = (select max(id) from snapshots)
  union all select 'timestamp', file_path, id, content from snapshots where created_at <= 2500 qualify row_number() over (partition by file_path order by created_at desc, id desc) = 1
  union all select 'latest', file_path, id, content from snapshots qualify row_number() over (partition by file_path order by created_at desc, id desc) = 1
  union all select 'prev', file_path, id, content from (select *, max(created_at) over (partition by file_path) as newest from snapshots) where created_at < newest qualify row_number() over (partition by file_path order by created_at desc, id desc) = 1)"""


def endpoints(spark, sf_dir):
    s = snapshots(spark, sf_dir)
    last = s.agg(F.max("id")).first()[0]
    ends = [("id", last), ("timestamp", 2500), ("latest", None), ("prev", None)]
    return reduce(DataFrame.unionByName, [D.endpoint(s, kind, value).withColumn("endpoint", F.lit(kind)) for kind, value in ends])


@sql("act_snapshot", f"with {ENDPOINTS} select endpoint, file_path, id, array_to_string(string_split(content, chr(10))[1:3], chr(10)) as lines from ends")
def act_snapshot(spark, sf_dir):
    """Files as they were at each kind of endpoint, cut to their first lines."""
    return endpoints(spark, sf_dir).select("endpoint", "file_path", "id", F.array_join(F.slice(F.split("content", "\n"), 1, 3), "\n").alias("lines"))


@sql("act_diff_endpoints", f"with {ENDPOINTS} select a.file_path, a.id as before, b.id as after, sha256(a.content) = sha256(b.content) as same from ends a join ends b on a.file_path = b.file_path and a.endpoint = 'prev' and b.endpoint = 'latest'")
def act_diff_endpoints(spark, sf_dir):
    """The last change of each file: two endpoints, whose digests tell whether there is anything to compare."""
    s = snapshots(spark, sf_dir)
    a, b = (D.endpoint(s, kind).select("file_path", F.col("id").alias(name), F.col("content").alias(f"{name}_content")) for kind, name in (("prev", "before"), ("latest", "after")))
    return a.join(b, "file_path").select("file_path", "before", "after", (F.sha2("before_content", 256) == F.sha2("after_content", 256)).alias("same"))


def neighbours(spark, sf_dir) -> DataFrame:
    """Each version with the one before it."""
    w = Window.partitionBy("file_path").orderBy("created_at", "id")
    s = snapshots(spark, sf_dir)
    return s.select("id", "content", F.lag("content").over(w).alias("before"), F.row_number().over(w).alias("rn")).where("rn > 1")


@query("act_diff")
def act_diff(spark, sf_dir):
    return D.diff(neighbours(spark, sf_dir), "id", "before", "content")


@query("dif_unified")
def dif_unified(spark, sf_dir):
    """Documents against themselves without every seventh line."""
    lines = F.split("text", "\n")
    thinned = F.array_join(F.filter(lines, lambda x, k: k % 7 != 3), "\n")
    return D.diff(table(spark, sf_dir, "documents").select("doc_id", "text", thinned.alias("thinned")), "doc_id", "text", "thinned").select("doc_id", "insertions", "deletions", "patch")


@sql("dif_stat", "select doc_id, 0::bigint as insertions, (len(l) - len(list_filter(l, lambda x, k: (k - 1) % 7 <> 3)))::bigint as deletions from (select doc_id, list_transform(string_split(text, chr(10)), lambda x, i: i::varchar || x) as l from documents)")
def dif_stat(spark, sf_dir):
    """Numbered lines, so that the difference is exact by construction."""
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.concat((k + 1).cast("string"), x))
    thinned = F.filter(lines, lambda x, k: k % 7 != 3)
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("a"), F.array_join(thinned, "\n").alias("b"))
    return D.diff(d, "doc_id", "a", "b").select("doc_id", "insertions", "deletions")


@sql("agg_diff_stat", "select count(*)::bigint as versions, sum(case when content <> b then 1 else 0 end)::bigint as changed from (select content, lag(content) over (partition by file_path order by created_at, id) as b from snapshots) where b is not null")
def agg_diff_stat(spark, sf_dir):
    d = D.diff(neighbours(spark, sf_dir), "id", "before", "content")
    return d.agg(F.count("*").alias("versions"), F.count_if(F.col("insertions") + F.col("deletions") > 0).alias("changed"))


@sql("act_worktree_status", "select case when file_id % 13 = 5 then 'untracked' when file_id % 11 = 4 then 'deleted' when file_id % 7 = 0 then 'modified' else 'clean' end as status, count(*)::bigint as n from files where not (file_id % 13 = 5 and file_id % 11 = 4) group by 1")
def act_worktree_status(spark, sf_dir):
    from .relational import jn_worktree_compare

    return jn_worktree_compare(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@sql("act_worktree_diff", "select file_id, 1::bigint as insertions, 0::bigint as deletions from files where file_id % 7 = 0")
def act_worktree_diff(spark, sf_dir):
    f = files(spark, sf_dir).where("file_id % 7 = 0").select("file_id", "text", F.concat("text", F.lit("\nadded")).alias("now"))
    return D.diff(f, "file_id", "text", "now").select("file_id", "insertions", "deletions")


# --- streams -------------------------------------------------------------------------------------------


def change_feed(spark, sf_dir, name):
    """The events as a stream of file changes, in several files."""
    where = scratch(spark, name)
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "rename").otherwise("upsert")
    path = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    rows = e.select(path("user_id").alias("path"), F.concat(F.lit("old"), F.col("user_id").cast("string")).alias("old_path"), op.alias("op"), F.col("event_id").alias("seq"))
    rows.repartitionByRange(3, "seq").write.parquet(where)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(where)


def finish(writer, spark, name):
    q = writer.option("checkpointLocation", scratch(spark, name)).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@sql("str_watch", "with l as (select 'u' || user_id as path, event_id as seq, event_type from events qualify row_number() over (partition by user_id order by event_id desc) = 1) select path, seq from l where event_type <> 'error'")
def str_watch(spark, sf_dir):
    """A table kept by a stream of upserts, deletes and renames; the last change of a path wins."""
    t = S.Table(spark, scratch(spark, "watch"), ["path"])
    stream = change_feed(spark, sf_dir, "feed")
    finish(C.watch(stream, t), spark, "watch-state")
    return C.present(t)


def timed_feed(spark, sf_dir, parts=4):
    """All events as file changes, in files that arrive in order of time, part by part, and a late word that tells each
    workspace how late it is."""
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("src/user_"), F.col("user_id").cast("string"), F.lit("/f"), (F.col("event_id") % 97).cast("string"))
    rows = e.select(F.concat(F.lit("ws"), (F.col("user_id") % 3).cast("string")).alias("key"), path.alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    where = scratch(spark, "timed")
    told = rows.agg(F.percentile_approx(F.unix_micros("ts"), [k / parts for k in range(1, parts)], 1000).alias("cuts"), F.max("ts").alias("last")).first()
    cuts = sorted(set(told["cuts"] or []))
    t = F.unix_micros("ts")
    for low, high in zip([None, *cuts], [*cuts, None]):
        some = rows if low is None else rows.where(t > low)
        (some if high is None else some.where(t <= high)).write.mode("append").parquet(where)
    late = rows.select("key").distinct().select("key", F.lit(None).cast("string").alias("path"), (F.lit(told["last"]) + F.expr("interval 60 days")).alias("ts"), F.lit(-1).cast("long").alias("seq"))
    late.write.mode("append").parquet(where)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(where)


@sql("str_debounce", """with recursive e as (
  select 'ws' || (user_id % 3) as key, 'src/user_' || user_id || '/f' || (event_id % 97) as path, epoch_us(ts) as t, row_number() over (partition by user_id % 3 order by ts, event_id) as k from events),
fold(key, k, pending, last, ended, reason, flushed) as (
  select distinct key, 0::bigint, []::varchar[], 0::bigint, 0::bigint, null::varchar, []::varchar[] from e
  union all
  select key, k, case when len(now) >= 256 then [] else now end, t, case when rested then last + 3600000000 else t end,
         case when rested then 'quiet' when len(now) >= 256 then 'full' end, case when rested then pending else now end
  from (select e.key, e.k, e.t, f.pending, f.last, len(f.pending) > 0 and f.last + 3600000000 <= e.t as rested,
               case when f.last + 3600000000 <= e.t then [e.path] when list_contains(f.pending, e.path) then f.pending else list_append(f.pending, e.path) end as now
        from fold f join e on e.key = f.key and e.k = f.k + 1)),
found as (
  select key, k, ended, reason, flushed from fold where reason is not null
  union all select key, k + 1, last + 3600000000, 'quiet', pending from fold where len(pending) > 0 and (key, k) in (select (key, max(k)) from e group by key))
select key, row_number() over (partition by key order by k) - 1 as number, ended, reason, len(flushed)::bigint as paths, sha256(array_to_string(list_sort(flushed), ',')) as digest from found""")
def str_debounce(spark, sf_dir):
    """Changes of each workspace in batches: an hour of quiet or 256 paths end one."""
    done, failed = (S.Table(spark, scratch(spark, name)) for name in ("batches", "failed"))
    batches = debounced(timed_feed(spark, sf_dir), "1 hour", "14 days")
    finish(deliver(batches, done, failed, lambda batch: batch, "debounce"), spark, "debounce-state")
    return done.read().withColumn("ended", F.unix_micros("ended"))


@sql("str_watch_legacy", "select 'src/user_' || user_id as file_path, count(*)::bigint as n from events group by 1")
def str_watch_legacy(spark, sf_dir):
    """What a stream marks stale, summed over its batches."""
    out = S.Table(spark, scratch(spark, "marks"), ["file_path"])

    def mark(batch, number):
        part = batch.groupBy(F.concat(F.lit("src/user_"), F.substring("path", 2, 20)).alias("file_path")).agg(F.count("*").alias("n"))
        out.upsert(part, lambda old, new: old.unionByName(new).groupBy("file_path").agg(F.sum("n").alias("n")), ("marks", number))

    finish(change_feed(spark, sf_dir, "feed").writeStream.foreachBatch(mark).trigger(availableNow=True), spark, "mark-state")
    return out.read()


@sql("str_incremental", """with recursive ch as (select file_path as node from symbols where symbol_id % 97 = 0 or symbol_id % 89 = 0), w(node) as (select node from ch union select e.source from w join import_edges e on e.target = w.node)
select w.node as path, case when s.symbol_id % 89 = 0 then 'deleted' when s.symbol_id % 97 = 0 then 'changed' else 'invalidated' end as state from w join symbols s on s.file_path = w.node""")
def str_incremental(spark, sf_dir):
    s = symbols(spark, sf_dir)
    before = s.select("symbol_id", F.col("file_path").alias("path"), F.lit("h").alias("hash"))
    now = s.where("symbol_id % 89 <> 0").select("symbol_id", F.col("file_path").alias("path"), F.when(F.col("symbol_id") % 97 == 0, "new").otherwise("h").alias("hash"))
    return C.incremental(before, now, import_edges(spark, sf_dir), ["symbol_id"])


@sql("str_queue", "select path, min(seq) as seq from (select 'u' || user_id as path, event_id as seq from events where event_type in ('view', 'click')) group by path")
def str_queue(spark, sf_dir):
    """A queue with one pending entry for each path, kept by streaming deduplication."""
    t = S.Table(spark, scratch(spark, "queue"), ["path"])

    def queue(batch, _):
        t.upsert(batch.select("path", "seq"), lambda old, new: S.first_wins(old.unionByName(new), ["path"], "seq"))

    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click')").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq"))
    where = scratch(spark, "queue-feed")
    e.repartitionByRange(3, "seq").write.parquet(where)  # the first of a path counts, whatever order batches come in
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(where)
    finish(stream.writeStream.foreachBatch(queue).trigger(availableNow=True), spark, "queue-state")
    return t.read()


@sql("str_witness", f"select user_id, event_type, count(*)::bigint as n, least(100, sum({WEIGHT_SQL}))::bigint as confidence, max(ts) as last_seen from events group by all")
def str_witness(spark, sf_dir):
    """The same fold as a streaming aggregation with Spark's own state."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    where, out = scratch(spark, "witness-feed"), S.Table(spark, scratch(spark, "witness"), ["user_id", "event_type"])
    e.repartitionByRange(3, "event_id").write.parquet(where)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(where)

    def keep(batch, _):
        out.upsert(batch)  # the state's newest rows

    finish(C.witness(stream, WEIGHTS).writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True), spark, "witness-state")
    return out.read()


@sql("str_idempotent", "select user_id as key, min(event_id) as event_id, count(distinct user_id)::bigint as applied from events group by 1")
def str_idempotent(spark, sf_dir):
    """Commands that come many times are applied once each, the first of each batch counting; the effects
    are what a log holds in the end."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.sha2(F.col("event_id").cast("string"), 256).alias("payload_hash"), "event_id")
    where = scratch(spark, "command-feed")
    done, log = S.Table(spark, scratch(spark, "done"), ["key"]), S.Table(spark, scratch(spark, "applied"), ["key"])
    half = e.agg(F.max("event_id") / 2).first()[0]
    state = scratch(spark, "command-state")
    for some in (e.where(F.col("event_id") < half), e):  # the second run, from the same state, repeats the first one's commands
        some.write.mode("append").parquet(where)
        stream = spark.readStream.schema(e.schema).parquet(where)
        q = C.exactly_once(stream, done, log, lambda fresh: fresh.select("key", "event_id"), "commands", "event_id").option("checkpointLocation", state).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    return log.read().groupBy("key").agg(F.min("event_id").alias("event_id"), F.count("*").alias("applied"))


@sql("win_tumbling", "select time_bucket(interval 1 day, ts) as day, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by all")
def win_tumbling(spark, sf_dir):
    """Day windows with a watermark over a stream, each emitted when it closes; a last event far ahead
    closes all, and is itself left open."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    where, out = scratch(spark, "tumbling-feed"), scratch(spark, "tumbling")
    e.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(where)
    end = e.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select("ts", F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"))
    end.coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema(e.schema).parquet(where).withWatermark("ts", "7 days")
    days = stream.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    days = days.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")
    finish(days.writeStream.outputMode("append").format("parquet").option("path", out).trigger(availableNow=True), spark, "tumbling-state")
    return spark.read.schema(days.schema).parquet(out)
