"""Registered queries: traversal, paths, cycles, reachability, communities, audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions.text import NO_IDENTIFIERS, VERBS, loaded_identifiers
from ..operators import community as C
from ..operators import graph as G
from ..sources.adapters import changelog, files, import_edges, main_edges, references, symbols, table, vectors, with_views
from ..operators.paths import resolve
from ..operators.retrieval import nearest, rrf, with_rank
from ..shared import cut
from .registry import query
from .retrieval import AROUND, FILE_SCORES, NAMED, exported, file_scores, places
from .relational import FILLED, all_edges, degrees, fans, filled_fields


def sql(key, statement):
    return query(key, with_views(statement))


def hub(edges, column):
    """The node with the most edges at ``column``; ties to the smaller name."""
    return edges.groupBy(F.col(column).alias("node")).agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("n"), "node")).alias("b")).select("b.node")


def hub_sql(view, column):
    return f"(select {column} from {view} group by 1 order by count(*) desc, 1 limit 1)"


def walk_sql(view, start, depth, back=False, many=False):
    """A recursive walk to a depth: levels of (node, depth) as a set, then the least depth."""
    a, b = ("target", "source") if back else ("source", "target")
    return f"""with recursive walk(node, depth) as (select {start} as node, 0 union select e.{b}, w.depth + 1 from walk w join {view} e on e.{a} = w.node and e.source <> e.target where w.depth < {depth})
select node, min(depth)::int as depth from walk group by node"""


@sql("g_edges", "select edge_type, count(*)::bigint as edges, count(distinct source)::bigint as sources from all_edges group by edge_type")
def g_edges(spark, sf_dir):
    return all_edges(spark, sf_dir).groupBy("edge_type").agg(F.count("*").alias("edges"), F.count_distinct("source").alias("sources"))


@sql("g_bfs", walk_sql("all_edges", hub_sql("all_edges", "source"), 4))
def g_bfs(spark, sf_dir):
    e = all_edges(spark, sf_dir)
    return G.bfs(e, hub(e, "source"), 4)


def paths_sql(view, start, depth):
    """Level by level: each new node with the least path of its parents; ends in ``walked`` (node, depth, path)."""
    levels = [f"d as (select distinct source, target from {view} where source <> target), l0 as (select {start} as node, [{start}] as path)"]
    for k in range(1, depth + 1):
        seen = " union all ".join(f"select node from l{j}" for j in range(k))
        levels.append(f"l{k} as materialized (select target as node, list_append(min(path), target) as path from l{k - 1} join d on source = node where target not in ({seen}) group by target)")
    whole = " union all ".join(f"select node, {k}::int as depth, path from l{k}" for k in range(depth + 1))
    return ", ".join(levels) + f", walked as ({whole})"


@sql("g_bfs_paths", f"with {paths_sql('all_edges', hub_sql('all_edges', 'source'), 4)} select node, depth, array_to_string(path, '>') as path from walked")
def g_bfs_paths(spark, sf_dir):
    """With one path for each node, through the parent discovered first."""
    e = all_edges(spark, sf_dir)
    return G.bfs(e, hub(e, "source"), 4, paths=True).select("node", "depth", F.array_join("path", ">").alias("path"))


@sql("g_impact", walk_sql("all_edges", hub_sql("all_edges", "target"), 3, back=True))
def g_impact(spark, sf_dir):
    """What a change of the most used node can reach: backwards along all edges."""
    e = all_edges(spark, sf_dir)
    return G.bfs(G.reversed_(e), hub(e, "target"), 3)


@sql("g_impact_symbol", f"""with recursive walk(node, depth) as (select distinct source, 1 from refs where target = {hub_sql('refs', 'target')} union select e.source, w.depth + 1 from walk w join all_edges e on e.target = w.node and e.source <> e.target where w.depth < 3)
select node, min(depth)::int as depth from walk group by node""")
def g_impact_symbol(spark, sf_dir):
    """Users of one symbol, and what uses them."""
    r = references(spark, sf_dir)
    direct = r.join(hub(r, "target").withColumnRenamed("node", "target"), "target", "left_semi").select(F.col("source").alias("node"))
    out = G.bfs(G.reversed_(all_edges(spark, sf_dir)), direct, 2)
    return out.select("node", (F.col("depth") + 1).alias("depth"))


@sql("g_impact_detailed", f"""with recursive walk(node, depth, usages) as (select {hub_sql('all_edges', 'target')}, 0, 0::bigint union all
  select e.source, w.depth + 1, e.usage_count from walk w join all_edges e on e.target = w.node and e.source <> e.target where w.depth < 2)
select node, min(depth)::int as depth, sum(greatest(1, usages))::bigint as usages, round(sum(greatest(1, usages) / depth::double), 6) as score from walk where depth > 0 group by node""")
def g_impact_detailed(spark, sf_dir):
    """Impact scored by use and nearness over all walks."""
    e = all_edges(spark, sf_dir).where("source <> target").select("source", "target", "usage_count")
    frontier = hub(e, "target").withColumn("depth", F.lit(0))
    steps = []
    for level in (1, 2):
        frontier = cut(frontier.select(F.col("node").alias("target")).join(e, "target").select(F.col("source").alias("node"), F.lit(level).alias("depth"), F.greatest(F.lit(1), "usage_count").alias("usages")))
        steps.append(frontier)
    rows = steps[0].unionByName(steps[1])
    return rows.groupBy("node").agg(F.min("depth").alias("depth"), F.sum("usages").alias("usages"), F.round(F.sum(F.col("usages") / F.col("depth").cast("double")), 6).alias("score"))


@sql("g_neighbors", f"""with c as (select {hub_sql('import_edges', 'source')} as node) select target as neighbor, 'imports' as direction from import_edges where source = (select node from c) union select source, 'importers' from import_edges where target = (select node from c)""")
def g_neighbors(spark, sf_dir):
    e = import_edges(spark, sf_dir)
    c = F.broadcast(hub(e, "source"))
    out = e.join(c, F.col("source") == F.col("node")).select(F.col("target").alias("neighbor"), F.lit("imports").alias("direction"))
    return out.union(e.join(c, F.col("target") == F.col("node")).select("source", F.lit("importers"))).distinct()


@sql("g_neighbors_detailed", f"""with c as (select {hub_sql('all_edges', 'source')} as node), n1 as (select source, target, edge_type, usage_count, 1 as depth from all_edges where source = (select node from c)),
n2 as (select e.source, e.target, e.edge_type, e.usage_count, 2 as depth from all_edges e where e.source in (select target from n1) and e.source <> (select node from c)) select source, target, edge_type, usage_count, depth::int as depth from (select * from n1 union all select * from n2)""")
def g_neighbors_detailed(spark, sf_dir):
    """Edges by depth around one node."""
    e = all_edges(spark, sf_dir).select("source", "target", "edge_type", "usage_count")
    seen = G.bfs(e, hub(e, "source"), 1)
    return e.join(seen.select(F.col("node").alias("source"), (F.col("depth") + 1).alias("depth")), "source").select("source", "target", "edge_type", "usage_count", "depth")


UNIQUE = "u as (select name || ' ' || raw_kind || ' ' || line_start as name, min(file_path) as node from symbols group by 1 having count(*) = 1)"


@sql("g_trace", f"with {UNIQUE}, {paths_sql('import_edges', '(select min(node) from u)', 8)} select depth as hops, array_to_string(path, '>') as path from walked where node = (select max(node) from u)")
def g_trace(spark, sf_dir):
    """A shortest path of at most eight hops between two symbols. Endpoints are names that exactly one
    symbol bears: the ones of the first and the last file."""
    s = symbols(spark, sf_dir).withColumn("name", F.concat_ws(" ", "name", "raw_kind", "line_start"))
    named = G.unique_symbols(s).agg(F.min("node").alias("a"), F.max("node").alias("b")).first()
    return G.trace(import_edges(spark, sf_dir), named.a, named.b, 8).select("hops", F.array_join("path", ">").alias("path"))


@sql("g_trace_path", f"with {paths_sql('all_edges', hub_sql('all_edges', 'source'), 8)} select node, len(path)::int as n, array_to_string(path, '>') as path from walked where depth = (select max(depth) from walked)")
def g_trace_path(spark, sf_dir):
    """One shortest path to each of the farthest nodes within eight hops."""
    e = all_edges(spark, sf_dir)
    walked = G.bfs(e, hub(e, "source"), 8, paths=True)
    far = walked.agg(F.max("depth").alias("depth"))
    return walked.join(F.broadcast(far), "depth").select("node", F.size("path").alias("n"), F.array_join("path", ">").alias("path"))


def cheapest_sql(start, hops):
    """Costs layer by layer over ``w`` (source, target, cost): the least of all walks of up to so many hops."""
    layers = [f"c0 as (select {start} as node, 0.0::double as cost)"]
    layers += [f"c{k} as materialized (select target as node, round(min(c.cost + w.cost), 9) as cost from c{k - 1} c join w on w.source = c.node group by target)" for k in range(1, hops + 1)]
    return ", ".join(layers), " union all ".join(f"select * from c{k}" for k in range(hops + 1))


COST = "case edge_type when 'import' then 1.0 when 'runtime_call' then 1.0 when 'reexport' then 0.75 when 'type_ref' then 1.25 when 'config_ref' then 1.5 else 1.1 end::double"


_LAYERS, _ALL = cheapest_sql(hub_sql("all_edges", "source"), 8)


@sql("g_trace_weighted", f"""with w as (select source, target, min({COST}) as cost from all_edges group by all), {_LAYERS} select node, round(min(cost), 6) as cost from ({_ALL}) group by node""")
def g_trace_weighted(spark, sf_dir):
    """Cheapest simple paths of at most eight edges."""
    e = all_edges(spark, sf_dir).select("source", "target", G.edge_cost(F.col("edge_type")).alias("cost"))
    start = hub(e, "source").first()[0]
    return G.cheapest_paths(e, start, 8).select("node", F.round("cost", 6).alias("cost"))


@sql("g_trace_detailed", f"""with x as (select source, target, {COST} as cost from all_edges union all select target, source, case edge_type when 'import' then 1.5 else 1.5 * {COST} end from all_edges), w as (select source, target, min(cost) as cost from x group by all), {_LAYERS} select node, round(min(cost), 6) as cost from ({_ALL}) group by node""")
def g_trace_detailed(spark, sf_dir):
    """The same over edges that may also be walked backwards at a higher cost."""
    e = all_edges(spark, sf_dir)
    cost = G.edge_cost(F.col("edge_type"))
    back = F.when(F.col("edge_type") == "import", 1.5).otherwise(1.5 * cost)
    start = hub(e, "source").first()[0]
    both = e.select("source", "target", cost.alias("cost")).unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"), back.alias("cost")))
    return G.cheapest_paths(both, start, 8).select("node", F.round("cost", 6).alias("cost"))


@sql("g_reach_path", f"""with recursive walk(node) as (select {hub_sql('import_edges', 'source')} union select e.target from walk w join import_edges e on e.source = w.node) select node from walk""")
def g_reach_path(spark, sf_dir):
    e = import_edges(spark, sf_dir)
    return G.reachable(e, hub(e, "source"))


SCC = """with recursive reach(a, b) as (select source, target from all_edges where source <> target union select r.a, e.target from reach r join all_edges e on e.source = r.b and e.source <> e.target),
mutual as (select x.a as node, min(least(x.a, x.b)) as scc from reach x join reach y on x.a = y.b and x.b = y.a where x.a <> x.b group by x.a) """


@sql("g_cycles", SCC + "select node, scc, count(*) over (partition by scc)::bigint as size from mutual")
def g_cycles(spark, sf_dir):
    """Members of each cycle of two or more, a row each: a component may hold most of a graph."""
    return G.cycles(all_edges(spark, sf_dir))


MAIN_SCC = SCC.replace("all_edges", "main_edges")


@sql("g_cycles_main", MAIN_SCC + "select node, scc, count(*) over (partition by scc)::bigint as size from mutual")
def g_cycles_main(spark, sf_dir):
    """Cycles where each file has one main import: several small ones at the ends of long ways."""
    return G.cycles(main_edges(spark, sf_dir))


@sql("g_cycles_file", MAIN_SCC + "select node, scc, count(*) over (partition by scc)::bigint as size from mutual where scc = (select min(m.scc) from mutual m where m.node = (select max(node) from mutual)) union all select source, source, 1 from main_edges where source = target and source = (select max(node) from mutual) and source not in (select node from mutual)")
def g_cycles_file(spark, sf_dir):
    """The cycle that holds one file."""
    e = main_edges(spark, sf_dir)
    last = G.cycles(e).agg(F.max("node").alias("node"))
    return G.cycles(e, holding=last)


@sql("g_cycles_detailed", SCC + "select m.scc, count(distinct m.node)::bigint as size, count(distinct (e.source, e.target))::bigint as edges from mutual m join all_edges e on e.source = m.node join mutual t on t.node = e.target and t.scc = m.scc group by m.scc")
def g_cycles_detailed(spark, sf_dir):
    """Components with the edges inside them."""
    e = all_edges(spark, sf_dir).select("source", "target").distinct()
    s = G.strong_components(e)
    inside = e.join(s.select(F.col("node").alias("source"), "scc"), "source").join(s.select(F.col("node").alias("target"), F.col("scc").alias("other")), "target").where("scc = other")
    sizes = s.groupBy("scc").agg(F.count("*").alias("size"))
    return inside.groupBy("scc").agg(F.count("*").alias("edges")).join(sizes, "scc").select("scc", "size", "edges")


@sql("g_scc_size", SCC + "select n.node, coalesce(count(m2.node), 0)::bigint as size from (select source as node from all_edges union select target from all_edges) n left join mutual m on m.node = n.node left join mutual m2 on m2.scc = m.scc group by n.node")
def g_scc_size(spark, sf_dir):
    """Members of each node's cycle; 0 outside any."""
    e = all_edges(spark, sf_dir)
    s = G.strong_components(e)
    sizes = s.join(s.groupBy("scc").agg(F.count("*").alias("size")), "scc").select("node", "size")
    nodes = e.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    return nodes.join(sizes, "node", "left").select("node", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


@sql("g_reach_entrypoints", "select file_path as node from symbols where file_path not in (select target from all_edges where source <> target)")
def g_reach_entrypoints(spark, sf_dir):
    return entrypoints(symbols(spark, sf_dir).select(F.col("file_path").alias("node")), all_edges(spark, sf_dir))


def entrypoints(nodes, edges):
    """Nodes that nothing points to; self-edges don't count."""
    return nodes.join(edges.where("source <> target").select(F.col("target").alias("node")), "node", "left_anti")


@sql("g_reach_dead_files", "select file_path as node from symbols where file_path not in (select target from all_edges) and file_path not in (select source from all_edges)")
def g_reach_dead_files(spark, sf_dir):
    e = all_edges(spark, sf_dir)
    n = symbols(spark, sf_dir).select(F.col("file_path").alias("node"))
    return n.join(e.select(F.explode(F.array("source", "target")).alias("node")), "node", "left_anti")


@sql("g_reach_dead_exports", "select symbol_id from symbols where exported and file_path not in (select target from refs) order by symbol_id limit 20")
def g_reach_dead_exports(spark, sf_dir):
    s = symbols(spark, sf_dir).where("exported").join(references(spark, sf_dir).select(F.col("target").alias("file_path")), "file_path", "left_anti")
    return s.select("symbol_id").orderBy("symbol_id").limit(20)


#: Files of an application, one for each part: its number decides the folder. A part's import is its main one; every
#: fortieth and the next one import each other alone.
APP = """app as (select 'part_' || lpad(k::string, 6, '0') as node, case
  when k = 4 then 'index.ts' when k % 50 = 0 then 'app/api/r' || k || '/route.ts' when k % 50 = 1 then 'app/p' || k || '/page.tsx' when k % 50 = 2 then 'app/p' || k || '/layout.tsx'
  when k % 50 = 3 then 'src/m' || k || '/server.ts' when k % 25 = 6 then 'src/f' || k || '.test.ts' when k % 25 = 7 then 'src/tests/f' || k || '.ts' when k % 75 = 8 then 'src/c' || k || '/vite.config.ts'
  when k % 20 = 10 then 'lib/f' || k || '.ts' when k % 80 = 11 then 'lib/f' || (k - 1) || '.js' else 'lib/f' || k || '.ts' end as path from (select p_partkey as k from part)),
linked as (select source, target from main_edges where substr(source, 6)::int % 40 not in (10, 11) and substr(target, 6)::int % 40 not in (10, 11)
  union all select a.node, b.node from app a join app b on abs(substr(b.node, 6)::int - substr(a.node, 6)::int) = 1 and least(substr(a.node, 6)::int, substr(b.node, 6)::int) % 40 = 10)"""
TESTS_OR_CONFIG = r"/(__tests__|__mocks__|test|tests|spec|specs|fixtures)/|\.(test|spec)\.[cm]?[jt]sx?$|(^|/)(next|vite|vitest|jest|playwright|cypress|eslint|tailwind|postcss|babel|webpack)\.config\.[cm]?[jt]s$"
# The kinds of entry points, in the order in which a path is tried.
ENTRIES = {
    "route": r"(?:^|/)app/(?:.*/)?api/.+/route\.[jt]sx?$",
    "page": r"(?:^|/)app/(?:.*/)?page\.[jt]sx?$",
    "layout": r"(?:^|/)app/(?:.*/)?layout\.[jt]sx?$",
    "root_index": r"^index\.[cm]?[jt]sx?$",
    "other": r"(?:^|/)(main|server|index|entry|app)\.[cm]?[jt]sx?$",
}
#: Extensions of a source and of what is compiled from it.
COMPANIONS = {".ts": ".js", ".tsx": ".jsx", ".mts": ".mjs", ".cts": ".cjs"}
ENTRY_SQL = "case " + " ".join(f"when regexp_matches(path, '{p}') then '{k}'" for k, p in ENTRIES.items()) + " end"
PAIR_SQL = "case " + " ".join(f"when ends_with(path, '{a}') then left(path, length(path) - {len(a)}) || '{b}'" for x, y in COMPANIONS.items() for a, b in ((x, y), (y, x))) + " end"
REACH = f"""{APP},
shown as (select node, path, {ENTRY_SQL} as entry, {PAIR_SQL} as pair from app where not regexp_matches(path, '{TESTS_OR_CONFIG}')),
edges as (select source, target from linked where source in (select node from shown) and target in (select node from shown)),
roots as (select node, entry as bucket from shown where entry is not null union all select node, 'no_importers' from shown where node not in (select target from edges)),
walk(node, bucket) as (select node, bucket from roots union select e.target, w.bucket from walk w join edges e on e.source = w.node),
live as (select node, string_agg(bucket, ',' order by bucket) as reached_by from walk group by node),
states as (select s.node, s.path, s.entry, l.reached_by, case when l.node is not null then 'live'
  when exists (select 1 from shown p where p.path = s.pair and (p.node in (select node from live) or p.node in (select target from edges))) then 'companion' else 'dead' end as state
  from shown s left join live l using (node))"""


def app_files(spark, sf_dir):
    """(node, path, entry) of the files that are neither tests nor configuration, and the imports among them."""
    table(spark, sf_dir, "part").createOrReplaceTempView("lodestone_app_part")
    told = APP.split(",\nlinked as")[0].replace("from part", "from lodestone_app_part")
    entry = F.coalesce(*[F.when(F.col("path").rlike(p), k) for k, p in ENTRIES.items()])
    shown = cut(spark.sql(f"with {told} select * from app").where(~F.col("path").rlike(TESTS_OR_CONFIG)).withColumn("entry", entry))
    n = lambda c: F.substring(c, 6, 6).cast("int")
    main = main_edges(spark, sf_dir).where(~(n("source") % 40).isin(10, 11) & ~(n("target") % 40).isin(10, 11))
    # every fortieth file and the next one: an equi-join by number, of the files that are shown
    numbers = shown.select("node", n("node").alias("n"))
    pairs = numbers.where("n % 40 = 10").select(F.col("node").alias("source"), (F.col("n") + 1).alias("n")).join(numbers.withColumnRenamed("node", "target"), "n").select("source", "target")
    main = main.join(shown.select(F.col("node").alias("source")), "source", "left_semi").join(shown.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target")
    edges = main.unionByName(pairs).unionByName(G.reversed_(pairs))
    return shown, cut(edges)


def reach_states(spark, sf_dir):
    """(node, path, entry, reached_by, state): which kinds of entry points reach a file, all at once, a bit each. What
    none reaches is dead, but for the companion (.ts and .js, and so on) of a file that is reached or imported."""
    shown, edges = app_files(spark, sf_dir)
    kinds = [*ENTRIES, "no_importers"]
    roots = shown.select("node", F.col("entry").alias("bucket")).where("bucket is not null").unionByName(entrypoints(shown.select("node"), edges).withColumn("bucket", F.lit("no_importers")))
    bit = F.coalesce(*[F.when(F.col("bucket") == k, 1 << n) for n, k in enumerate(kinds)]).cast("long")
    reached = G.spread(edges, roots.select("node", F.lit(0).alias("block"), bit.alias("mask"))).select("node", "mask")
    imported = edges.select(F.col("target").alias("node")).distinct().withColumn("imported", F.lit(True))
    known = shown.join(reached, "node", "left").join(imported, "node", "left")
    pair = F.coalesce(*[F.when(F.endswith("path", F.lit(a)), F.concat(F.expr(f"left(path, length(path) - {len(a)})"), F.lit(b))) for x, y in COMPANIONS.items() for a, b in ((x, y), (y, x))])
    others = known.where("mask is not null or imported").select(F.col("path").alias("pair"), F.lit(True).alias("saved")).distinct()
    told = known.withColumn("pair", pair).join(others, "pair", "left")
    state = F.when(F.col("mask").isNotNull(), "live").when(F.col("saved"), "companion").otherwise("dead")
    names = F.array_sort(F.array_compact(F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(1 << n)) != 0, k) for n, k in enumerate(kinds)])))
    return told.select("node", "path", "entry", F.when(F.col("mask").isNotNull(), F.array_join(names, ",")).alias("reached_by"), state.alias("state"))


@sql("g_reach_detailed", f"with recursive {REACH} select node, path, entry, reached_by, state from states")
def g_reach_detailed(spark, sf_dir):
    """Which kinds of entry points reach each file, and what is dead."""
    return reach_states(spark, sf_dir)


@sql("g_reach_share", f"with recursive {REACH} select count(*)::bigint as files, count(*) filter (state = 'live')::bigint as reachable, count(*) filter (state = 'dead')::bigint as dead, round(100.0::double * count(*) filter (state = 'live') / count(*), 1) as share from states")
def g_reach_share(spark, sf_dir):
    count = lambda state: F.count_if(F.col("state") == state)
    return reach_states(spark, sf_dir).agg(F.count("*").alias("files"), count("live").alias("reachable"), count("dead").alias("dead"), F.round(100.0 * count("live") / F.count("*"), 1).alias("share"))


@sql("g_reach_export_reasons", f"""with recursive {REACH},
sites as (select r.target as node, count(*) filter (edge_type <> 'type_ref') as sites, coalesce(sum(usage_count) filter (edge_type <> 'type_ref' and r.source in (select node from live)), 0) as used from refs r group by 1)
select y.symbol_id, y.file_path as node, case when s.node is null then 'symbol missing from cross-references' when s.sites > 0 then 'consumers exist only in unreachable files' else 'no consumers' end as reason
from symbols y join live l on l.node = y.file_path left join sites s on s.node = y.file_path where y.exported and coalesce(s.used, 0) = 0""")
def g_reach_export_reasons(spark, sf_dir):
    """Exports of reachable files that no reachable file calls, and why; type references are no calls."""
    live = cut(reach_states(spark, sf_dir).where("state = 'live'").select("node"))
    calls = F.col("edge_type") != "type_ref"
    r = references(spark, sf_dir).join(live.select(F.col("node").alias("source"), F.lit(True).alias("reached")), "source", "left")
    sites = r.groupBy(F.col("target").alias("node")).agg(F.count_if(calls).alias("sites"), F.sum(F.when(calls & F.col("reached"), F.col("usage_count"))).alias("used"))
    s = symbols(spark, sf_dir).where("exported").select("symbol_id", F.col("file_path").alias("node")).join(live, "node").join(sites, "node", "left")
    reason = F.when(F.col("sites").isNull(), "symbol missing from cross-references").when(F.col("sites") > 0, "consumers exist only in unreachable files").otherwise("no consumers")
    return s.where(F.coalesce("used", F.lit(0)) == 0).select("symbol_id", "node", reason.alias("reason"))


@sql("g_subgraph", f"""with recursive walk(node, depth) as (select {hub_sql('import_edges', 'source')} as node, 0 union select e.target, w.depth + 1 from walk w join import_edges e on e.source = w.node where w.depth < 2), n as (select distinct node from walk)
select source, target from import_edges where source in (select node from n) and target in (select node from n)""")
def g_subgraph(spark, sf_dir):
    e = import_edges(spark, sf_dir)
    return induced(e, G.bfs(e, hub(e, "source"), 2))


def induced(edges, nodes):
    """Edges with both ends among the nodes."""
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "source"), "source", "left_semi").join(n.withColumnRenamed("node", "target"), "target", "left_semi").select(*edges.columns)


@sql("g_subgraph_detailed", f"""with recursive walk(node, depth) as (select {hub_sql('all_edges', 'source')} as node, 0 union select case when e.source = w.node then e.target else e.source end, w.depth + 1 from walk w join all_edges e on e.source = w.node or e.target = w.node where w.depth < 2), n as (select node, min(depth) as depth from walk group by node)
select e.source, e.target, e.edge_type, a.depth::int as source_depth, b.depth::int as target_depth from all_edges e join n a on a.node = e.source join n b on b.node = e.target""")
def g_subgraph_detailed(spark, sf_dir):
    """The same in both directions, with distances."""
    e = all_edges(spark, sf_dir)
    n = G.bfs(G.both_ways(e), hub(e, "source"), 2)
    out = e.select("source", "target", "edge_type").join(n.select(F.col("node").alias("source"), F.col("depth").alias("source_depth")), "source")
    return out.join(n.select(F.col("node").alias("target"), F.col("depth").alias("target_depth")), "target")


@sql("g_cluster_nodes", "with n as (select file_path from symbols where raw_kind = (select min(raw_kind) from symbols)) select source, target from import_edges where source in (select file_path from n) and target in (select file_path from n)")
def g_cluster_nodes(spark, sf_dir):
    s = symbols(spark, sf_dir)
    n = s.join(F.broadcast(s.agg(F.min("raw_kind").alias("raw_kind"))), "raw_kind", "left_semi").select(F.col("file_path").alias("node"))
    return induced(import_edges(spark, sf_dir), n)


@sql("g_consumers", f"with recursive walk(node) as (select {hub_sql('import_edges', 'target')} union select e.source from walk w join import_edges e on e.target = w.node) select node from walk")
def g_consumers(spark, sf_dir):
    """All that import a file, directly or not."""
    e = import_edges(spark, sf_dir)
    return G.reachable(G.reversed_(e), hub(e, "target"))


@sql("g_invalidate", "with recursive changed as (select file_path as node from symbols where symbol_id % 97 = 0), walk(node) as (select node from changed union select e.source from walk w join import_edges e on e.target = w.node) select node from walk where node in (select file_path from symbols where symbol_id % 89 <> 0)")
def g_invalidate(spark, sf_dir):
    """What a change makes stale, among the files that still exist."""
    s = symbols(spark, sf_dir)
    changed = s.where("symbol_id % 97 = 0").select(F.col("file_path").alias("node"))
    stale = G.reachable(G.reversed_(import_edges(spark, sf_dir)), changed)
    return stale.join(s.where("symbol_id % 89 <> 0").select(F.col("file_path").alias("node")), "node", "left_semi")


@sql("g_components", "with recursive u as (select source as a, target as b from all_edges union select target, source from all_edges), reach(a, b) as (select a, b from u union select r.a, u.b from reach r join u on u.a = r.b) select a as node, least(a, min(b)) as component from reach group by a")
def g_components(spark, sf_dir):
    return G.components(all_edges(spark, sf_dir))


WEIGHTED = "w as (select least(source, target) as source, greatest(source, target) as target, sum(greatest(1, usage_count))::bigint as weight from refs where source <> target group by all)"


def weighted(spark, sf_dir):
    r = references(spark, sf_dir).where("source <> target")
    return r.groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.sum(F.greatest(F.lit(1), "usage_count")).alias("weight"))


@sql("g_modularity", f"""with {WEIGHTED}, p as (select distinct node, substr(node, 1, 9) as part from (select source as node from w union select target from w)), m as (select 2.0::double * sum(weight) as m2 from w),
t as (select part, sum(weight) as total from (select source as node, weight from w union all select target, weight from w) join p using (node) group by part),
i as (select a.part, 2 * sum(weight) as inside from w join p a on a.node = w.source join p b on b.node = w.target where a.part = b.part group by a.part)
select round(sum(coalesce(inside, 0) / m2 - (total / m2) ** 2), 6) as modularity from t left join i using (part) cross join m""")
def g_modularity(spark, sf_dir):
    w = weighted(spark, sf_dir)
    parts = w.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("part", F.substring("node", 1, 9))
    return G.modularity(w, parts).select(F.round("modularity", 6).alias("modularity"))


@query("g_communities")
def g_communities(spark, sf_dir):
    return C.communities(weighted(spark, sf_dir))


@query("g_community_names")
def g_community_names(spark, sf_dir):
    """Names of all parts' communities by the folders of their files: a brand's, and in it a type's."""
    w = cut(weighted(spark, sf_dir))
    path = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/"), F.lower("p_type"), F.lit("/"), "node", F.lit(".ts"))
    paths = table(spark, sf_dir, "part").withColumn("node", F.concat(F.lit("part_"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))).select("node", path.alias("path"))
    return C.community_names(w.select("source", "target"), cut(C.communities(w)), paths)


#: Files under three folders that were renamed or are links, and renames of single files: of two thirds of the parts to
#: that of their main import; every tenth was deleted.
MOVES = """inputs as (select case k % 10 when 1 then 'link/' when 2 then 'old/' when 3 then 'loop1/' else 'src/' end || name as input from (select symbol_id as k, file_path as name from symbols)),
aliases as (select * from (values ('link', 'src', 'directory'), ('loop1', 'loop2', 'directory')) v("from", "to", kind)),
redirects as (select 'src/' || source as "from", case when substr(source, 6)::int % 10 <> 7 then 'src/' || target end as "to", 'file' as kind from main_edges where substr(source, 6)::int % 3 <> 0
  union all select * from (values ('old', 'link', 'directory'), ('loop2', 'loop1', 'directory')) v(a, b, kind))"""


@sql("fn_path_redirects", f"""with recursive {MOVES},
walk(input, path, seen, aliased, redirected, state) as (
  select input, input, [input], false, false, null::varchar from inputs
  union all
  select input, case when looped then null else coalesce(next, path) end, case when next is null then seen else list_append(seen, next) end, aliased, redirected or hit,
         case when looped then 'cycle' when hit and next is null then 'deleted' when not changed and not hit then 'current' end
  from (
    select x.*, r."to" is not null or r."from" is not null as hit, r."to" || substr(x.path, length(r."from") + 1) as next,
           (changed and list_contains(before, x.path)) or coalesce(list_contains(x.seen, r."to" || substr(x.path, length(r."from") + 1)), false) as looped
    from (
      select w.input, case when a."from" is null then w.path else a."to" || substr(w.path, length(a."from") + 1) end as path, w.seen as before,
             case when a."from" is null then w.seen else list_append(w.seen, a."to" || substr(w.path, length(a."from") + 1)) end as seen,
             w.aliased or a."from" is not null as aliased, w.redirected, a."from" is not null as changed
      from walk w left join aliases a on starts_with(w.path, a."from" || '/') where w.state is null) x
    left join redirects r on r."from" = x.path or (r.kind = 'directory' and starts_with(x.path, r."from" || '/'))))
select input, path, state, aliased, redirected from walk where state is not null""")
def fn_path_redirects(spark, sf_dir):
    """Where files are now, through links and any number of renames."""
    s = symbols(spark, sf_dir)
    k, name = F.col("symbol_id") % 10, F.col("file_path")
    inputs = s.select(F.concat(F.when(k == 1, "link/").when(k == 2, "old/").when(k == 3, "loop1/").otherwise("src/"), name).alias("input"))
    mapping = lambda *rows: spark.createDataFrame(rows, "`from` string, to string, kind string")
    n = F.substring("source", 6, 6).cast("int")
    renames = main_edges(spark, sf_dir).where(n % 3 != 0).select(F.concat(F.lit("src/"), "source").alias("from"), F.when(n % 10 != 7, F.concat(F.lit("src/"), "target")).alias("to"), F.lit("file").alias("kind"))
    folders = mapping(("old", "link", "directory"), ("loop2", "loop1", "directory"))
    return resolve(inputs, mapping(("link", "src", "directory"), ("loop1", "loop2", "directory")), renames.unionByName(folders))


HITS = FILE_SCORES + """,
hits as (select 'part_' || lpad(doc::varchar, 6, '0') as node, row_number() over (order by round(score, 9), doc) as rank from scored qualify rank <= 100)"""


def hits(spark, sf_dir, most):
    """The best lexical hits as nodes: a file's symbol bears the file's number."""
    best = file_scores(spark, sf_dir)[1].orderBy(F.round("score", 9), "doc").limit(most)
    return with_rank(best, F.round("score", 9), "doc").select(F.concat(F.lit("part_"), F.lpad(F.col("doc").cast("string"), 6, "0")).alias("node"), "rank")


@sql("act_plan_context", f"""with {HITS}, near as (select e.target as node from hits h join all_edges e on e.source = h.node where h.rank <= 20 union select e.source from hits h join all_edges e on e.target = h.node where h.rank <= 20)
select node, min(depth)::int as depth, string_agg(reason, ',' order by reason) as reasons from (select node, 0 as depth, 'lexical_match' as reason from hits union all select node, 1, 'neighbor_expansion' from near where node not in (select node from hits where rank <= 20)) group by node""")
def act_plan_context(spark, sf_dir):
    """The 100 best hits and the neighbours of the first 20, each with the reasons it is there."""
    found = cut(hits(spark, sf_dir, 100))
    near = G.bfs(G.both_ways(all_edges(spark, sf_dir)), found.where("rank <= 20").select("node"), 1).where("depth > 0")
    rows = found.select("node", F.lit(0).alias("depth"), F.lit("lexical_match").alias("reason")).unionByName(near.select("node", "depth", F.lit("neighbor_expansion").alias("reason")))
    return rows.groupBy("node").agg(F.min("depth").alias("depth"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@sql("act_plan_context_detailed", f"""with recursive {HITS},
asked as (select v.v from hits h join vectors v on 'part_' || lpad(v.vec_id::varchar, 6, '0') = h.node where h.rank <= 50 order by h.rank limit 1),
dense as (select 'part_' || lpad(vec_id::varchar, 6, '0') as node, row_number() over (order by d, vec_id) as rank
  from (select b.vec_id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2))) as d from asked a, vectors b) qualify rank <= 50),
fused as (select node, sum(1 / (60.0::double + rank)) as score from (select node, rank from hits where rank <= 50 union all select * from dense) group by node),
seeds as (select node from fused order by round(score, 9) desc, node limit 50),
walk(root, node, depth) as (select node, node, 0 from seeds union select w.root, case when e.source = w.node then e.target else e.source end, w.depth + 1 from walk w join all_edges e on e.source = w.node or e.target = w.node where w.depth < 2),
deg as (select node, count(*) as degree from (select source as node from all_edges union all select target from all_edges) group by node),
found as (select root, node, min(depth)::int as depth from walk group by all),
ranked as (select *, row_number() over (partition by root order by depth, node) as place from found)
select r.root, r.node, r.depth, coalesce(d.degree, 0)::bigint as blast_radius from ranked r left join deg d on d.node = r.node where place <= 51""")
def act_plan_context_detailed(spark, sf_dir):
    """Seeds by fused ranks (lexical hits, and the nearest vectors to that of the best hit which has one), up to 50
    neighbours of each within two steps."""
    e = all_edges(spark, sf_dir)
    lexical = hits(spark, sf_dir, 50).withColumnRenamed("node", "id")
    number = F.substring("id", 6, 12).cast("long")
    v = vectors(spark, sf_dir)
    best = lexical.select("rank", number.alias("vec_id")).join(v, "vec_id").orderBy("rank").limit(1).select(F.col("v").alias("q"))
    near = nearest(v, "vec_id", "v", best, 50)
    dense = with_rank(near, "distance", "id").select(F.concat(F.lit("part_"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), "rank")
    fused = rrf([lexical, dense])
    seeds = cut(fused.orderBy(F.desc(F.round("score", 9)), "id").limit(50).select(F.col("id").alias("root")))
    near = G.bfs_many(G.both_ways(e), seeds, 2)
    place = F.row_number().over(Window.partitionBy("root").orderBy("depth", "node"))
    near = near.withColumn("place", place).where("place <= 51")
    return near.join(degrees(e), "node", "left").select("root", "node", "depth", F.coalesce("degree", F.lit(0)).cast("long").alias("blast_radius"))


# --- audits --------------------------------------------------------------------------------------------


@sql("aud_gaps", "select file_path, gap, severity from (select file_path, unnest([{'gap': case when coalesce(purpose, '') = '' then 'purpose' end, 'severity': 'high'}, {'gap': case when coalesce(blurb, '') = '' then 'blurb' end, 'severity': 'high'}, {'gap': case when len(tags) = 0 then 'tags' end, 'severity': 'medium'}, {'gap': case when len(source_highlights) = 0 then 'source_highlights' end, 'severity': 'medium'}, {'gap': case when cross_references is null then 'cross_references' end, 'severity': 'medium'}, {'gap': case when len(patterns) = 0 then 'patterns' end, 'severity': 'low'}], recursive := true) from files) where gap is not null")
def aud_gaps(spark, sf_dir):
    """Up to six gaps of a file, with their severity."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    gap = lambda cond, name, severity: F.when(cond, F.struct(F.lit(name).alias("gap"), F.lit(severity).alias("severity")))
    none = lambda c: F.size(c) == 0
    gaps = F.array_compact(F.array(gap(empty("purpose"), "purpose", "high"), gap(empty("blurb"), "blurb", "high"), gap(none("tags"), "tags", "medium"), gap(none("source_highlights"), "source_highlights", "medium"), gap(F.col("cross_references").isNull(), "cross_references", "medium"), gap(none("patterns"), "patterns", "low")))
    return files(spark, sf_dir).select("file_path", F.inline(gaps))


METRICS = """m as (select s.file_path, s.line_start * 30 as loc, coalesce(d.degree, 0) as degree, coalesce(f.fan_in, 0) as fan_in, coalesce(f.fan_out, 0) as fan_out, coalesce(c.changes, 0) as changes, coalesce(c.breaking, 0) as breaking, s.symbol_id % 9 as hazards, coalesce(u.usages, 0) as usages, coalesce(date_diff('day', c.latest, timestamp '2024-02-15'), 999) as stale
 from symbols s left join (select node, count(*) as degree from (select source as node from all_edges union all select target from all_edges) group by node) d on d.node = s.file_path
 left join (select coalesce(a.n, b.n) as node, coalesce(fan_in, 0) as fan_in, coalesce(fan_out, 0) as fan_out from (select target as n, count(*) as fan_in from import_edges group by 1) a full join (select source as n, count(*) as fan_out from import_edges group by 1) b on a.n = b.n) f on f.node = s.file_path
 left join (select node, sum(usage_count) as usages from (select source as node, usage_count from refs union all select target, usage_count from refs) group by node) u on u.node = s.file_path
 left join (select 'part_' || lpad((id % 300)::varchar, 6, '0') as p, count(*) as changes, count(*) filter (breaking_changes) as breaking, date_trunc('day', max(created_at)) as latest from changelog group by 1) c on c.p = s.file_path)"""


def metrics(spark, sf_dir):
    e, r = all_edges(spark, sf_dir), references(spark, sf_dir)
    c = changelog(spark, sf_dir).groupBy(F.concat(F.lit("part_"), F.lpad((F.col("id") % 300).cast("string"), 6, "0")).alias("node"))
    c = c.agg(F.count("*").alias("changes"), F.count_if("breaking_changes").alias("breaking"), F.datediff(F.lit("2024-02-15").cast("date"), F.max("created_at").cast("date")).alias("stale"))
    used = r.select(F.explode(F.array("source", "target")).alias("node"), "usage_count").groupBy("node").agg(F.sum("usage_count").alias("usages"))
    s = symbols(spark, sf_dir).select(F.col("file_path").alias("node"), (F.col("line_start") * 30).alias("loc"), (F.col("symbol_id") % 9).alias("hazards"))
    out = s.join(degrees(e), "node", "left").join(fans(import_edges(spark, sf_dir)), "node", "left").join(c, "node", "left").join(used, "node", "left")
    return out.na.fill(0, ["degree", "fan_in", "fan_out", "changes", "breaking", "usages"]).na.fill(999, ["stale"]).withColumnRenamed("node", "file_path")


@sql("aud_smells", SCC + f", {METRICS} select file_path, 'large_file' as smell, 'high' as severity from m where loc >= 1000 union all select file_path, 'high_coupling', 'medium' from m where degree >= 10 union all select file_path, 'hazard_density', 'medium' from m where hazards >= 5 union all select distinct scc, 'dependency_cycle', 'high' from mutual union all select distinct source, 'dependency_cycle', 'high' from all_edges where source = target and source not in (select node from mutual)")
def aud_smells(spark, sf_dir):
    """Large, coupled and hazardous files, and each cycle under the name of its first member."""
    m = metrics(spark, sf_dir)
    smell = lambda cond, name, severity: F.when(cond, F.struct(F.lit(name).alias("smell"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(smell(F.col("loc") >= 1000, "large_file", "high"), smell(F.col("degree") >= 10, "high_coupling", "medium"), smell(F.col("hazards") >= 5, "hazard_density", "medium")))
    cycles = G.cycles(all_edges(spark, sf_dir), least=1).select(F.col("scc").alias("file_path"), F.lit("dependency_cycle").alias("smell"), F.lit("high").alias("severity")).distinct()
    return m.select("file_path", F.inline(found)).unionByName(cycles)


@sql("aud_smells_cycles", MAIN_SCC + "select scc as file_path, 'dependency_cycle' as smell, 'high' as severity, count(*)::bigint as size from mutual group by scc")
def aud_smells_cycles(spark, sf_dir):
    s = G.cycles(main_edges(spark, sf_dir))
    return s.groupBy(F.col("scc").alias("file_path")).agg(F.count("*").alias("size")).select("file_path", F.lit("dependency_cycle").alias("smell"), F.lit("high").alias("severity"), "size")


@sql("aud_hotspots", f"with {METRICS} select file_path, round(3 * changes + 2 * degree + log2(greatest(1, loc)), 6) as score from m order by score desc, file_path limit 20")
def aud_hotspots(spark, sf_dir):
    score = 3 * F.col("changes") + 2 * F.col("degree") + F.log2(F.greatest(F.lit(1), F.col("loc")))
    return metrics(spark, sf_dir).select("file_path", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "file_path").limit(20)


# The points of each smell.
POINTS = (
    ("loc > 500", 2), ("loc > 1000", 2), ("fan_in + fan_out > 20", 3), ("fan_in + fan_out > 40", 1), ("cycle > 1", 3), ("cycle >= 5", 1),
    ("changes > 5", 2), ("changes > 10", 1), ("hazards > 3", 2), ("hazards > 6", 1), ("usages > 0 and usages >= 0.75 * most", 1),
)


@sql("aud_smells_detailed", MAIN_SCC + f""", {METRICS}, sized as (select node, count(*) over (partition by scc) as cycle from mutual),
x as (select m.*, coalesce(z.cycle, 0) as cycle, max(usages) over () as most from m left join sized z on z.node = m.file_path),
s as (select file_path, least(10, {' + '.join(f'case when {c} then {n} else 0 end' for c, n in POINTS)})::bigint as severity, fan_in + fan_out as coupling, changes from x) select file_path, severity from s where severity >= 3 order by severity desc, coupling desc, changes desc, file_path limit 100""")
def aud_smells_detailed(spark, sf_dir):
    """Points that add up to a severity; the table of rules is data."""
    total = F.least(F.lit(10), sum((F.when(F.expr(cond), n).otherwise(0) for cond, n in POINTS), F.lit(0))).cast("long")
    m = metrics(spark, sf_dir).join(G.cycles(main_edges(spark, sf_dir)).select(F.col("node").alias("file_path"), F.col("size").alias("cycle")), "file_path", "left").na.fill(0, ["cycle"])
    m = m.crossJoin(F.broadcast(m.agg(F.max("usages").alias("most"))))  # one row
    m = m.withColumns({"severity": total, "coupling": F.expr("fan_in + fan_out")}).where("severity >= 3")
    return m.orderBy(F.desc("severity"), F.desc("coupling"), F.desc("changes"), "file_path").limit(100).select("file_path", "severity")


# Weight of each metric, and what makes it full (a number, or the largest of all files).
RISKS = (("hazards", 0.28, 5.0), ("fan_in", 0.20, None), ("fan_out", 0.12, None), ("changes", 0.18, None), ("breaking", 0.10, 3.0), ("loc", 0.07, 800.0), ("stale", 0.05, 30.0))


def _share_sql(name, full):
    return f"least({name} / {full}::double, 1)" if full else f"{name}::double / greatest(max({name}) over (), 1)"


@sql("aud_hotspots_detailed", f"""with {METRICS}, x as (select file_path, [{', '.join(f"{{'value': round({weight} * 1000000 * {_share_sql(name, full)})::bigint, 'name': '{name}'}}" for name, weight, full in RISKS)}] as parts from m),
r as (select file_path, parts, list_filter(parts, lambda p: p.value > 0) as told from x)
select file_path, list_sum(list_transform(parts, lambda p: p.value))::double / 1000000 as risk, array_to_string(list_transform(list_sort(list_transform(told, lambda p: {{'v': -p.value, 'n': p.name}}))[1:3], lambda q: q.n), ',') as reasons from r""")
def aud_hotspots_detailed(spark, sf_dir):
    """Seven weighted metrics, each from 0 to 1, and the three that weigh most."""
    m = metrics(spark, sf_dir)
    top = m.agg(*[F.max(name).alias(f"max_{name}") for name, _, full in RISKS if not full])
    share = lambda name, full: F.least(F.col(name) / full, F.lit(1.0)) if full else F.col(name) / F.greatest(F.col(f"max_{name}"), F.lit(1))
    parts = F.array(*[F.struct((-F.round(weight * 1_000_000 * share(name, full)).cast("bigint")).alias("v"), F.lit(name).alias("n")) for name, weight, full in RISKS])
    rows = m.crossJoin(F.broadcast(top)).select("file_path", parts.alias("parts"))  # one row
    risk = -F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + p["v"]) / 1_000_000
    reasons = F.slice(F.array_sort(F.filter("parts", lambda p: p["v"] < 0)), 1, 3)
    return rows.select("file_path", risk.alias("risk"), F.array_join(F.transform(reasons, lambda p: p["n"]), ",").alias("reasons"))


#: Cross-references of files as they are stored, JSON of all kinds, by number.
CROSS_REFS = """case file_id % 10 when 0 then '{}' when 1 then '{"symbols":{},"crossref_timestamp":"2024-01-01T00:00:00Z"}' when 2 then '{"symbols":{"readDoc":{"total_usages":' || (file_id % 4) || '}},"crossref_timestamp":"2024-01-01T00:00:00Z"}'
  when 3 then null when 4 then '{"symbols":{"a":{}},"crossref_timestamp":"t","crossref_model":"scaffold"}' when 5 then '{"symbols":{},"total_exports_analyzed":0,"crossref_model":"heuristic","pass2_timestamp":"t"}'
  when 6 then '{bad' when 7 then 'null' when 8 then '{"symbols":{"a":{}}}' else '[]' end"""
READ_REFS = f"""refs_read as (select *, case when json_valid(c) and json_type(c) = 'OBJECT' then c::json end as j from (select *, {CROSS_REFS} as c from files)),
refs_told as (select *, coalesce(len(json_keys(j, '$.symbols')), 0) as n, j ->> '$.crossref_timestamp' as stamped, j ->> '$.pass2_timestamp' as second, j ->> '$.crossref_model' as model, j ->> '$.total_exports_analyzed' as analysed from refs_read)"""


def with_cross_refs(rows):
    """``rows`` of files with what their cross-references say; nothing where they are no JSON object."""
    read = rows.withColumn("c", F.expr(CROSS_REFS))
    field = lambda name: F.get_json_object("c", f"$.{name}")
    names = F.map_keys(F.from_json(F.when(F.col("c").startswith("{"), field("symbols")), "map<string,string>"))
    told = {"stamped": "crossref_timestamp", "second": "pass2_timestamp", "model": "crossref_model", "analysed": "total_exports_analyzed"}
    return read.select("*", F.coalesce(F.size(names), F.lit(0)).alias("n"), *[field(v).alias(k) for k, v in told.items()])


CHECKS_SQL = """list_filter([case when trim(coalesce(blurb, '')) = '' then 'blurb' end, case when trim(coalesce(purpose, '')) = '' then 'purpose' end, case when coalesce(extraction_model, 'scaffold') = 'scaffold' then 'extraction' end,
  case when n = 0 and coalesce(stamped, '') = '' then 'cross_refs' end, case when len(hazards) = 0 then 'hazards' end, case when len(conventions) = 0 then 'conventions' end, case when len(key_types) = 0 then 'key_types' end, case when len(data_flows) = 0 then 'data_flows' end], lambda x: x is not null)"""


@sql("aud_incomplete_entry", f"with {READ_REFS}, m as (select *, {CHECKS_SQL} as missing from refs_told) select file_path, array_to_string(missing, ',') as missing, len(missing) || '/8' as share, extraction_model from m where len(missing) > 0")
def aud_incomplete_entry(spark, sf_dir):
    """Which of eight checks a record fails, and who extracted it last."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    checks = {"blurb": blank("blurb"), "purpose": blank("purpose"), "extraction": F.coalesce("extraction_model", F.lit("scaffold")) == "scaffold", "cross_refs": (F.col("n") == 0) & (F.coalesce("stamped", F.lit("")) == "")}
    checks |= {c: F.coalesce(F.size(c), F.lit(0)) <= 0 for c in ("hazards", "conventions", "key_types", "data_flows")}
    missing = F.array_compact(F.array(*[F.when(cond, k) for k, cond in checks.items()]))
    rows = with_cross_refs(files(spark, sf_dir)).withColumn("missing", missing).where(F.size("missing") > 0)
    return rows.select("file_path", F.array_join("missing", ",").alias("missing"), F.concat(F.size("missing").cast("string"), F.lit("/8")).alias("share"), "extraction_model")


@sql("aud_incomplete_tiers", f"""with t as (select file_path, loc, {FILLED} as f from files) select file_path, case when loc <= 50 then 'tiny' when loc <= 200 then 'small' when loc <= 600 then 'medium' when loc <= 1500 then 'large' else 'huge' end as tier,
  array_to_string(list_filter(case when loc <= 50 then ['blurb', 'tags'] when loc <= 200 then ['blurb', 'purpose', 'tags'] when loc <= 600 then ['blurb', 'purpose', 'tags', 'hazards'] when loc <= 1500 then ['blurb', 'purpose', 'tags', 'hazards', 'patterns', 'source_highlights'] else ['blurb', 'purpose', 'tags', 'hazards', 'patterns', 'source_highlights', 'key_types'] end, lambda x: not list_contains(f, x)), ',') as missing from t""")
def aud_incomplete_tiers(spark, sf_dir):
    """Files of all tiers, and what each lacks of what its tier requires."""
    f = files(spark, sf_dir).select("file_path", M.tier(F.col("loc")).alias("tier"), filled_fields().alias("f"))
    return f.select("file_path", "tier", F.array_join(F.array_except(M.required(F.col("tier")), "f"), ",").alias("missing"))


@sql("aud_reindex_stats", "select case when file_id % 11 = 4 then 'pruned' when file_id % 7 = 0 then 'stale' when extraction_model is null then 'incomplete' else 'complete' end as state, count(*)::bigint as files from files group by 1")
def aud_reindex_stats(spark, sf_dir):
    f = files(spark, sf_dir)
    disk = f.where("file_id % 11 <> 4").select("file_path", F.sha1(F.when(F.col("file_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("now"))
    state = F.when(F.col("now").isNull(), "pruned").when(F.col("now") != F.col("file_hash"), "stale").when(F.col("extraction_model").isNull(), "incomplete").otherwise("complete")
    return f.select("file_path", "file_hash", "extraction_model").join(disk, "file_path", "left").groupBy(state.alias("state")).agg(F.count("*").alias("files"))


@sql("aud_file_phase", f"""with {READ_REFS}, now as (select *, case when file_id % 11 = 4 then null when file_id % 7 = 0 then sha1(text || '!') else sha1(text) end as current from refs_told)
select file_path, case when current is distinct from file_hash then 'none'
  when coalesce(model, '') <> 'scaffold' and (stamped is not null or second is not null) and (n > 0 or (analysed = '0' and model = 'heuristic')) then 'crossref' else 'structure' end as phase from now""")
def aud_file_phase(spark, sf_dir):
    """How far a file is: nothing where its text has changed or is gone, its structure, or its cross-references, if
    those hold symbols, or a heuristic found no export, and are dated and no scaffold."""
    f = with_cross_refs(files(spark, sf_dir))
    i = F.col("file_id")
    current = F.when(i % 11 == 4, F.lit(None)).when(i % 7 == 0, F.sha1(F.concat("text", F.lit("!")))).otherwise(F.sha1("text"))
    done = (F.coalesce("model", F.lit("")) != "scaffold") & (F.col("stamped").isNotNull() | F.col("second").isNotNull()) & ((F.col("n") > 0) | ((F.col("analysed") == "0") & (F.col("model") == "heuristic")))
    phase = F.when(~current.eqNullSafe(F.col("file_hash")), "none").when(done, "crossref").otherwise("structure")
    return f.select("file_path", phase.alias("phase"))


@sql("aud_exported_not_referenced", "with words as (select distinct unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) as w from documents) select symbol_id from symbols where exported and file_path not in (select target from refs) and lower(string_split(name, ' ')[1]) not in (select w from words)")
def aud_exported_not_referenced(spark, sf_dir):
    """Exports without a use whose name no context holds: contexts are split into words once."""
    words = files(spark, sf_dir).select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9_]+"))).alias("w")).distinct()
    s = symbols(spark, sf_dir).where("exported").join(references(spark, sf_dir).select(F.col("target").alias("file_path")), "file_path", "left_anti")
    return s.withColumn("w", F.lower(F.element_at(F.split("name", " "), 1))).join(words, "w", "left_anti").select("symbol_id")


IDENTIFIERS = rf"""flows as (select file_id, unnest(data_flows) as flow from files),
told as (
  select file_id, unnest(regexp_extract_all(flow, '(?i)\b(?:{VERBS})\s+`([A-Za-z_$][\w$]*)`', 1)) as symbol, true as strong, true as quoted from flows
  union all select file_id, unnest(regexp_extract_all(flow, '(?i)\b(?:{VERBS})\s+([A-Za-z_$][\w$]*)', 1)), true, false from flows
  union all select file_id, unnest(regexp_extract_all(flow, '`([A-Za-z_$][\w$]*)`', 1)), false, true from flows),
loaded as (select file_id, symbol, bool_or(strong) as strong from told
  where case when quoted then length(symbol) >= 2 else length(symbol) >= 4 and regexp_matches(symbol, '^([A-Z][A-Za-z0-9_$]*|[a-z]+[A-Z][A-Za-z0-9_$]*)$')
    and lower(symbol) not in ({", ".join(f"'{w}'" for w in sorted(NO_IDENTIFIERS))}) end group by all)"""


@sql("aud_loaded_not_used", rf"""with recursive {NAMED}, {AROUND}, {IDENTIFIERS},
seen(node, word) as (
  select distinct 'part_' || lpad(defined::varchar, 6, '0'), word from (select defined, unnest(regexp_extract_all(context, '[\p{{L}}\p{{N}}_$]+')) as word from shown join named using (symbol)) where word in (select symbol from loaded)
  union select e.target, s.word from seen s join import_edges e on e.source = s.node)
select file_id, symbol, strong from loaded where ('part_' || lpad(file_id::varchar, 6, '0'), symbol) not in (select (node, word) from seen)""")
def aud_loaded_not_used(spark, sf_dir):
    """Identifiers that a file's data flows name and that occur in no context of a use of its export, nor of those
    of any file that imports it, however far. Words travel along imports as bits."""
    node = lambda c: F.concat(F.lit("part_"), F.lpad(F.col(c).cast("string"), 6, "0")).alias("node")
    flows = files(spark, sf_dir).select("file_id", F.explode("data_flows").alias("flow"))
    told = cut(flows.select("file_id", F.inline(loaded_identifiers(F.col("flow")))).groupBy("file_id", "symbol").agg(F.max("strong").alias("strong")))
    bits = C.numbered(told.select("symbol").distinct(), "symbol", "n").select("symbol", F.floor(F.col("n") / G.BITS).alias("block"), F.expr(f"shiftleft(1L, cast(n % {G.BITS} as int))").alias("bit"))
    loaded = cut(told.join(bits, "symbol").select("file_id", node("file_id"), "symbol", "strong", "block", "bit"), told)
    words = loaded.select(F.col("symbol").alias("word"), "block", "bit").distinct()
    seeds = places(spark, sf_dir).near(exported(spark, sf_dir), words).select(node("defined"), "block", "mask")
    reached = G.spread(import_edges(spark, sf_dir), seeds, loaded)
    known = loaded.join(reached, ["node", "block"], "left")
    return known.where(F.coalesce(F.col("mask").bitwiseAND(F.col("bit")), F.lit(0)) == 0).select("file_id", "symbol", "strong")
