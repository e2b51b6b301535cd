"""Graph operators over edge frames (source, target).

Loops write their state to the shared folder each round (``cut``) and delete what no later round reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def reversed_(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(reversed_(edges)).distinct()


#: Levels that are kept as tables of their own before they are made one.
LAYERS = 8


def _walk(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], keys: list[str], depth: int | None) -> DataFrame:
    """``start`` and, level by level, the rows that ``step`` makes of the last level and whose ``keys`` are new; to
    ``depth``, or to the end. A level is written once, beside those before it."""
    layers = [cut(start)]
    level = 0
    last = layers[0]
    while depth is None or level < depth:
        level += 1
        seen = reduce(DataFrame.unionByName, [x.select(*keys) for x in layers])
        last = cut(step(last, level).join(seen, keys, "left_anti"))
        if last.isEmpty():
            break
        layers.append(last)
        if len(layers) > LAYERS:  # the last one is still to be stepped from
            layers = [cut(reduce(DataFrame.unionByName, layers[:-1]), *layers[:-1]), last]
    return reduce(DataFrame.unionByName, layers)


def bfs(edges: DataFrame, roots: DataFrame, depth: int | None, paths: bool = False) -> DataFrame:
    """(node, depth[, path]) of all nodes within ``depth`` steps of ``roots`` (node); null: of all that there are.

    A level is one join of the frontier with the edges and one anti-join with what was seen. With
    ``paths``, a node's path goes through the parent that was discovered first, as a traversal with
    sorted neighbours has it. Nodes of one level are discovered in the order of their paths, so the
    first parent is the one with the least path: a partial minimum, no numbering.
    """
    edges = cut(edges.where("source <> target").select("source", "target").distinct())
    start = roots.select("node").distinct().withColumn("depth", F.lit(0))

    def step(frontier: DataFrame, level: int) -> DataFrame:
        found = frontier.join(edges, F.col("node") == F.col("source"))
        if not paths:
            return found.select(F.col("target").alias("node")).distinct().withColumn("depth", F.lit(level))
        found = found.select(F.col("target").alias("node"), "path").groupBy("node").agg(F.min("path").alias("path"))
        return found.select("node", F.lit(level).alias("depth"), F.concat("path", F.array("node")).alias("path"))

    return _walk(start.withColumn("path", F.array("node")) if paths else start, step, ["node"], depth)


def bfs_many(edges: DataFrame, roots: DataFrame, depth: int | None) -> DataFrame:
    """(root, node, depth) from each of many roots (root) at once."""
    edges = cut(edges.where("source <> target").select("source", "target").distinct())
    start = roots.select("root", F.col("root").alias("node")).distinct().withColumn("depth", F.lit(0))
    step = lambda frontier, level: frontier.join(edges, F.col("node") == F.col("source")).select("root", F.col("target").alias("node")).distinct().withColumn("depth", F.lit(level))
    return _walk(start, step, ["root", "node"], depth)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) reachable from roots (node), roots included, to the end."""
    return bfs(edges, roots, None).select("node")


#: Bits of a mask: the sign is left alone.
BITS = 62


#: Steps after which ``cores`` is content with what it has found, and the part of all labels that must still move for more.
CORE_STEPS, CORE_MOVES = 32, 0.01


def cores(edges: DataFrame) -> DataFrame:
    """(node, core): nodes that share a strong component with the node ``core``, for the large components at least.

    Along and against the edges each node learns of the node of most edges that leads to it, and that it leads to;
    where the two are the same they share a component, however few steps were taken. So it may end when
    little moves: what it has not found are nodes for themselves."""
    ways = edges.select(F.col("source").alias("node"), F.col("target").alias("to"), F.lit(True).alias("ahead"))
    ways = cut(ways.unionByName(ways.select(F.col("to").alias("node"), F.col("node").alias("to"), F.lit(False).alias("ahead"))))
    degrees = ways.groupBy("node").agg(F.least(F.count_if("ahead"), F.count_if(~F.col("ahead"))).alias("n"))
    labels = degrees.select("node", F.explode(F.array(F.lit(True), F.lit(False))).alias("ahead"), F.struct((-F.col("n")).alias("n"), "node").alias("best"), F.lit(True).alias("moved"))
    made: list[DataFrame] = []
    for _ in range(CORE_STEPS):
        came = labels.where("moved").join(ways, ["node", "ahead"]).groupBy(F.col("to").alias("node"), "ahead").agg(F.min("best").alias("came"))
        better = F.coalesce(F.col("came") < F.col("best"), F.lit(False))
        labels = cut(labels.join(came, ["node", "ahead"], "left").select("node", "ahead", F.when(better, F.col("came")).otherwise(F.col("best")).alias("best"), better.alias("moved")), *made)
        made = [labels]
        all_, moved = labels.agg(F.count("*"), F.count_if("moved")).first()
        if moved <= CORE_MOVES * all_:
            break
    one = F.min("best.node").alias("core"), F.max("best.node").alias("other")
    return labels.groupBy("node").agg(*one).where("core = other").select("node", "core")


def spread(edges: DataFrame, seeds: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(node, block, mask): for each node, or each of ``wanted`` (node), the bits of all ``seeds`` (node, block, mask)
    from which edges lead to it, its own included. A level hands on new bits only, or'ed per node and block, so
    that facts about BITS things travel as one; it ends when a level brings nothing new. Edges that no seed leads
    to are left out first. Nodes of one strong component have the same bits, so that large ones (``cores``) are made
    one node first; where no more than LOCAL_EDGES edges are left, all are. Where no node has two edges, steps double."""
    edges = cut(edges.where("source <> target").select("source", "target").distinct())
    if edges.groupBy("source").count().where("count > 1").isEmpty():
        found = _spread_along(edges, seeds)
        return found if wanted is None else found.join(wanted.select("node").distinct(), "node", "left_semi")
    seeds = cut(seeds)
    edges = cut(edges.join(_led_to(edges, seeds), F.col("source") == F.col("node"), "left_semi"), edges)
    if edges.count() <= LOCAL_EDGES:
        kind = edges.schema["source"].dataType
        strong = strong_components(edges.select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target")))
        core = cut(strong.select(F.col("node").cast(kind).alias("node"), F.col("scc").cast(kind).alias("core")))
    else:
        core = cut(cores(edges))
    of = lambda rows, side: rows.join(core.select(F.col("node").alias(side), "core"), side, "left").withColumn(side, F.coalesce("core", side)).drop("core")
    edges = cut(of(of(edges, "source"), "target").where("source <> target").select("source", "target").distinct(), edges)
    bits = of(seeds, "node").groupBy("node", "block").agg(F.bit_or("mask").alias("mask")).where("mask <> 0")
    seen = cut(bits.withColumn("fresh", F.col("mask")))
    while not seen.where("fresh <> 0").isEmpty():
        step = seen.where("fresh <> 0").join(edges, F.col("node") == F.col("source")).groupBy(F.col("target").alias("node"), "block").agg(F.bit_or("fresh").alias("came"))
        had, came = F.coalesce("mask", F.lit(0)), F.coalesce("came", F.lit(0))
        seen = cut(seen.join(step, ["node", "block"], "full").select("node", "block", had.bitwiseOR(came).alias("mask"), came.bitwiseAND(F.bitwise_not(had)).alias("fresh")), seen)
    single = seen.select("node", "block", "mask")
    if wanted is not None:
        wanted = wanted.select("node").distinct()
        core, single = core.join(wanted, "node", "left_semi"), single.join(wanted, "node", "left_semi")
    single = single.join(core.select("node"), "node", "left_anti")
    return single.unionByName(core.join(seen.select(F.col("node").alias("core"), "block", "mask"), "core").select("node", "block", "mask"))


def _led_to(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): ``roots`` (node) and what they lead to by ``edges``, which are stored and have no loops."""
    step = lambda frontier, _: frontier.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
    return _walk(roots.select("node").distinct(), step, ["node"], None)


def _spread_along(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``spread`` where every node has one edge at most: jumps of 1, 2, 4 ... edges, and after each the bits of all
    nodes that lie fewer edges back. It ends when no jump is left, or, on cycles, when jumps are longer than
    there are edges or bring nothing new."""
    jumps, seen = edges, cut(seeds.groupBy("node", "block").agg(F.bit_or("mask").alias("mask")).where("mask <> 0"))
    left, most = edges.count(), edges.count()
    told = seen.agg(F.count("*"), F.sum(F.bit_count("mask"))).first()
    reach = 1
    while left and reach <= 2 * most:
        came = seen.join(jumps, F.col("node") == F.col("source")).select(F.col("target").alias("node"), "block", "mask")
        after = cut(seen.unionByName(came).groupBy("node", "block").agg(F.bit_or("mask").alias("mask")), seen)
        now = after.agg(F.count("*"), F.sum(F.bit_count("mask"))).first()
        seen = after
        if now == told:
            break
        told = now
        ahead = jumps.select(F.col("source").alias("target"), F.col("target").alias("end"))
        jumps = cut(jumps.join(ahead, "target").select("source", F.col("end").alias("target")), jumps)
        left, reach = jumps.count(), 2 * reach
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node connected with each; nodes with self-edges only name themselves.

    Stars alternate: each node hands its larger neighbours, then its smaller ones, to the least node that
    it knows, until all hang on their component's least node. Rounds grow with the logarithm of a
    component's size; every step is a partial minimum and an equi-join."""
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    now = cut(edges.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, now)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), large)
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or not seen[0]:
            return nodes.join(now.select(F.col("u").alias("node"), "v"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))
        mark = seen


#: Edges that one task takes when a loop over all executors has no more to gain from them.
LOCAL_EDGES = 500_000


def _tarjan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, scc) of components of two nodes or more, by a depth-first search without recursion."""
    out: dict[str, list[str]] = {}
    for part in parts:
        for a, b in zip(part.column("source").to_pylist(), part.column("target").to_pylist(), strict=True):
            out.setdefault(a, []).append(b)
            out.setdefault(b, [])
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: list[str] = []
    held: set[str] = set()
    rows: list[tuple[str, str]] = []
    for root in out:
        if root in number:
            continue
        work = [(root, iter(out[root]))]
        number[root] = low[root] = len(number)
        open_.append(root)
        held.add(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    open_.append(to)
                    held.add(to)
                    work.append((to, iter(out[to])))
                    break
                if to in held:
                    low[node] = min(low[node], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(open_.pop())
                    held.difference_update(members)
                    if len(members) > 1:
                        least = min(members)
                        rows += [(m, least) for m in members]
    node, scc = zip(*rows, strict=True) if rows else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.string()), pa.array(scc, pa.string())], ["node", "scc"])


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, scc) of nodes in strong components of two nodes or more; scc is the smallest member.

    Nodes that no cycle can hold are trimmed until none is left to trim. Then every node takes the
    smallest node that reaches it as its colour; within a colour, what reaches the colour's node is
    its component, which leaves the graph. Once no more than LOCAL_EDGES edges are left, one task reads
    their components off, since rounds over long ways cost more than that. A node that is alone in its component has no row; whether it
    points to itself is for the caller to see from the edges.
    """
    edges = cut(edges.where("source <> target").select("source", "target").distinct())
    out = None
    while True:
        size = edges.count()
        while size > LOCAL_EDGES:
            kept = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            edges = cut(kept.join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"), edges)
            before, size = size, edges.count()
            if size == before:
                break
        if not size:
            break
        if size <= LOCAL_EDGES:
            found = edges.coalesce(1).mapInArrow(_tarjan, "node string, scc string")
            out = cut(found) if out is None else cut(out.unionByName(found), out)
            break
        colour = cut(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("c", F.col("node")))
        changed = True
        while changed:
            passed = edges.join(colour, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.min("c").alias("m"))
            after = colour.join(passed, "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved"))
            after = cut(after, colour)
            changed = not after.where("moved").isEmpty()
            colour = after
        colour = cut(colour.select("node", "c"), colour)
        inside = edges.join(colour.select(F.col("node").alias("source"), F.col("c").alias("a")), "source").join(colour.select(F.col("node").alias("target"), F.col("c").alias("b")), "target").where("a = b")
        back = bfs_many_within(inside.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("a").alias("c")), colour)
        sizes = back.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
        found = back.join(sizes, "c", "left_semi").select("node", F.col("c").alias("scc"))
        out = cut(found) if out is None else cut(out.unionByName(found), out)
        done = back.select("node")
        edges = cut(edges.join(done.withColumnRenamed("node", "source"), "source", "left_anti").join(done.withColumnRenamed("node", "target"), "target", "left_anti"), edges)
    if out is None:
        return edges.select(F.col("source").alias("node"), F.col("source").alias("scc")).where("false")
    return out


def cycles(edges: DataFrame, least: int = 2, holding: DataFrame | None = None) -> DataFrame:
    """(node, scc, size) of the members of components with at least ``least`` members; scc is the smallest
    one. A node that points to itself is a component of one, if it is in no larger one. With ``holding``
    (one row: node) only the component that holds that node."""
    edges = cut(edges.select("source", "target"))
    strong = strong_components(edges)
    if least < 2:
        loops = edges.where("source = target").select(F.col("source").alias("node")).distinct()
        strong = strong.unionByName(loops.join(strong, "node", "left_anti").select("node", F.col("node").alias("scc")))
    if holding is not None:
        strong = strong.join(strong.join(holding.select("node"), "node", "left_semi").select("scc"), "scc", "left_semi")
    sizes = strong.groupBy("scc").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return strong.join(sizes, "scc").select("node", "scc", "size")


def unique_symbols(symbols: DataFrame) -> DataFrame:
    """(name, node): names that exactly one symbol (name, file_path) bears, and its file."""
    return symbols.groupBy("name").agg(F.min("file_path").alias("node"), F.count("*").alias("n")).where("n = 1").select("name", "node")


def trace(edges: DataFrame, start: str, goal: str, hops: int) -> DataFrame:
    """One row (hops, path): the shortest path that a traversal with sorted neighbours finds from
    ``start`` to ``goal`` within ``hops`` steps; no row if there is none."""
    edges = cut(edges.where("source <> target").select("source", "target").distinct())
    frontier = cut(edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.array(F.lit(start)).alias("path")))
    seen = cut(frontier.select("node"))
    for level in range(hops + 1):
        found = frontier.where(F.col("node") == goal)
        if level == hops or not found.isEmpty():
            return found.select(F.lit(level).alias("hops"), "path")
        step = frontier.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node"), "path")
        least = step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti")
        frontier = cut(least.select("node", F.concat("path", F.array("node")).alias("path")), frontier)
        seen = cut(seen.unionByName(frontier.select("node")), seen)
    raise AssertionError


def bfs_many_within(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """(node, c): what each colour's own node reaches by edges (source, target, c) of that colour."""
    edges = cut(edges)
    seen = frontier = cut(colour.where("node = c").select("node", "c"))
    while True:
        step = frontier.select(F.col("node").alias("source"), "c").join(edges, ["source", "c"]).select(F.col("target").alias("node"), "c").distinct()
        after = cut(step.join(seen, ["node", "c"], "left_anti"))
        if after.isEmpty():
            return seen
        old = [seen] if frontier is seen else [seen, frontier]
        seen, frontier = cut(seen.unionByName(after), *old), after


# The cost of a step by edge type; any other type costs OTHER_COST.
COSTS = {"import": 1.0, "runtime_call": 1.0, "reexport": 0.75, "type_ref": 1.25, "config_ref": 1.5}
OTHER_COST = 1.1


def edge_cost(kind: Column) -> Column:
    return reduce(lambda out, item: out.when(kind == item[0], item[1]), COSTS.items(), F.when(F.lit(False), 0.0)).otherwise(OTHER_COST)


def cheapest_paths(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """(node, cost, path): the cheapest simple path of at most ``hops`` edges (source, target, cost)
    from ``start``; ties by length, then by path. Layer by layer, the best path to a node for each
    number of hops."""
    edges = cut(edges.groupBy("source", "target").agg(F.min("cost").alias("w")))
    layer = edges.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0.0).alias("cost"), F.array(F.lit(start)).alias("path"))
    layers = [cut(layer)]
    for _ in range(hops):
        step = layers[-1].join(edges, F.col("node") == F.col("source")).where(~F.array_contains("path", F.col("target")))
        best = step.select(F.col("target").alias("node"), F.struct(F.round(F.col("cost") + F.col("w"), 9).alias("cost"), F.concat("path", F.array("target")).alias("path")).alias("b"))
        best = cut(best.groupBy("node").agg(F.min("b").alias("b")).select("node", "b.cost", "b.path"))
        if best.isEmpty():
            break
        layers.append(best)
    rows = reduce(DataFrame.unionByName, layers)
    order = F.struct("cost", F.size("path").alias("n"), "path")
    return rows.groupBy("node").agg(F.min(order).alias("b")).select("node", "b.cost", "b.path")


def modularity(edges: DataFrame, parts: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row (modularity) of undirected weighted edges (source, target, weight) under a partition
    (node, part)."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"), "weight").join(parts, "node").groupBy("part").agg(F.sum("weight").alias("total"))
    within = (
        edges.join(parts.select(F.col("node").alias("source"), F.col("part").alias("a")), "source")
        .join(parts.select(F.col("node").alias("target"), F.col("part").alias("b")), "target")
        .where("a = b").groupBy(F.col("a").alias("part")).agg((2 * F.sum("weight")).alias("inside"))
    )
    whole = edges.agg((2.0 * F.sum("weight")).alias("m2"))
    rows = ends.join(within, "part", "left").join(F.broadcast(whole))
    return rows.agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m2") - gamma * F.pow(F.col("total") / F.col("m2"), 2)).alias("modularity"))
