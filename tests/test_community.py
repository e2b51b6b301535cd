"""Communities against a plain version, level by level, and their names."""

import random
from collections import Counter, defaultdict

import pytest

from lodestone.operators import community, graph

EDGES = "source string, target string, weight long"


def quality(edges, part):
    m2 = 2 * sum(edges.values())
    total, inside = Counter(), Counter()
    for (a, b), w in edges.items():
        total[part[a]] += w
        total[part[b]] += w
        inside[part[a]] += 2 * w * (part[a] == part[b])
    return sum(inside[p] / m2 - (total[p] / m2) ** 2 for p in total)


def split(edges, part):
    around = defaultdict(set)
    for a, b in edges:
        if part[a] == part[b]:
            around[a].add(b)
            around[b].add(a)
    out = {}
    for node in sorted(part):
        todo = [] if node in out else [node]
        while todo:
            at = todo.pop()
            if at not in out:
                out[at] = node
                todo += around[at]
    return out


def plain(edges):
    """One node after the other, in order, to the best community; split; the graph of communities; again."""
    k = Counter()
    for (a, b), w in edges.items():
        k[a] += w
        k[b] += w
    m2 = sum(k.values())
    member = {n: n for n in k}
    while True:
        around = defaultdict(Counter)
        for (a, b), w in edges.items():
            around[a][b] += w
            around[b][a] += w
        part, total, moved = {n: n for n in k}, Counter(k), False
        for _ in range(100):
            again = False
            for n in sorted(k):
                toward = Counter()
                for o, w in around[n].items():
                    toward[part[o]] += w
                own = part[n]
                total[own] -= k[n]
                best, gain = own, toward[own] - k[n] * total[own] / m2
                for c in sorted(toward):
                    if toward[c] - k[n] * total[c] / m2 > gain + 1e-9:
                        best, gain = c, toward[c] - k[n] * total[c] / m2
                total[best] += k[n]
                if best != own:
                    part[n], again, moved = best, True, True
            if not again:
                break
        if not moved:
            return member
        part = split(edges, part)
        member = {n: part[m] for n, m in member.items()}
        up, strength = Counter(), Counter()
        for (a, b), w in edges.items():
            if part[a] != part[b]:
                up[tuple(sorted((part[a], part[b])))] += w
        for n, w in k.items():
            strength[part[n]] += w
        edges, k = up, strength


def planted(seed, inner=0.6, outer=0.03):
    rng = random.Random(seed)
    groups, size = rng.randint(4, 8), rng.randint(6, 12)
    nodes = [f"{seed}n{g:02}_{i:02}" for g in range(groups) for i in range(size)]
    edges = Counter()
    for a in nodes:
        for b in nodes:
            if a < b and rng.random() < (inner if a[:4] == b[:4] else outer):
                edges[a, b] += rng.randint(1, 3)
    return edges


def test_as_good_as_plain_and_connected(spark):
    """Five graphs side by side, of plain and of blurred groups."""
    edges = sum((planted(seed, (0.6, 0.35)[seed % 2]) for seed in range(5)), Counter())
    rows = [(a, b, w) if k % 2 else (b, a, w) for k, ((a, b), w) in enumerate(edges.items())]
    levels = [{r["node"]: r["part"] for r in level.collect()} for level in community.community_levels(spark.createDataFrame([*rows, (rows[0][0], rows[0][0], 50)], EDGES))]
    found = levels[-1]
    assert quality(edges, found) >= quality(edges, plain(edges)) - 1e-9
    for level in levels:
        assert level == split(edges, level)  # connected, and named by their least nodes
    assert len(set(found.values())) <= len(set(levels[0].values()))


def test_blocks_move_one_after_the_other(spark, monkeypatch):
    """Whole blocks settle in a round: few rounds, and groups are found as well when nodes are dealt over several
    blocks; long communities are split into what hangs together."""
    edges = sum((planted(seed, (0.6, 0.35)[seed % 2]) for seed in range(5)), Counter())
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], EDGES)
    rounds, rated = [], community._rated
    monkeypatch.setattr(community, "_rated", lambda *given: rounds.append(given[-1]) or rated(*given))
    community.communities(frame)
    assert len(rounds) <= 25 and set(rounds) == {1}
    monkeypatch.setattr(community, "BLOCK", sum(len(e) for e in edges) // 4)
    found = {r["node"]: r["part"] for r in community.communities(frame).collect()}
    assert max(rounds) > 2 and found == split(edges, found)
    assert quality(edges, found) >= 0.98 * quality(edges, plain(edges))
    chain = spark.createDataFrame([(k, k + d) for k in range(60) for d in (1, -1) if 0 <= k + d < 60 and {k, k + d} != {29, 30}], "source long, target long")
    parts = spark.createDataFrame([(k, 7, 2) for k in range(61)], "node long, part long, k long")
    assert {r["node"]: r["part"] for r in community._connected(chain, parts).collect()} == {k: 0 if k < 30 else 30 if k < 60 else 60 for k in range(61)}


def test_levels_nest_and_empty(spark):
    edges = {(f"c{g}_{a}", f"c{g}_{b}"): 5 for g in range(6) for a in range(4) for b in range(a)}
    edges |= {(f"c{g}_0", f"c{g + 1}_0"): 1 for g in (0, 2, 4)}
    one, *_ = community.community_levels(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], EDGES))
    part = {r["node"]: r["part"] for r in one.collect()}
    assert all(part[f"c{g}_{a}"] == f"c{g}_0" for g in range(6) for a in range(4))
    assert community.communities(spark.createDataFrame([], EDGES)).count() == 0
    assert community.communities(spark.createDataFrame([("a", "a", 1)], EDGES)).count() == 0


def names(edges, parts, paths, least=2):
    """The rule told one by one: later names of one base are numbered past names in use."""
    found = {}
    for a, b in edges:
        found.setdefault(a, a), found.setdefault(b, b)
    comp = split(edges, {n: 0 for n in {*found, *parts}})
    groups = defaultdict(list)
    for n in sorted(parts):
        groups[parts[n]].append(n)
    groups = {p: m for p, m in groups.items() if len(m) >= least}
    folder = lambda n: paths[n].rpartition("/")[0]
    slug = lambda ns: min(Counter(map(folder, ns)).items(), key=lambda x: (-x[1], x[0]))[0].removeprefix("src/").strip("/")
    every = sorted(set(comp.values()))
    bases = []
    by_comp = defaultdict(list)
    for p, m in sorted(groups.items(), key=lambda x: x[1][0]):
        by_comp[comp[m[0]]].append((p, m))
    for ordinal, c in enumerate(sorted(by_comp), 1):
        parent = slug([n for _, m in by_comp[c] for n in m]) or f"cluster-{ordinal}"
        for k, (p, m) in enumerate(by_comp[c], 1):
            child = slug(m) or f"cluster-{every.index(c) + 1}-{k}"
            child = f"cluster-{k}" if child == parent or child.startswith(parent + "/") else child
            bases.append((p, parent if len(by_comp[c]) == 1 else f"{parent}/{child}"))
    used, out = {b for _, b in bases}, {}
    seen = set()
    for p, b in bases:
        name, k = b, 2
        while name in seen or (name != b and name in used):
            name, k = f"{b}-{k}", k + 1
        seen.add(name)
        out[p] = name
    fallback = lambda n: "dir/" + ("-".join(x for k, x in enumerate(folder(n).split("/")) if x and (k == 0 or folder(n).split("/")[k - 1] != x)).replace("_", "-") or "root")
    return {n: out.get(parts.get(n)) or fallback(n) for n in paths}


def test_names(spark):
    rng = random.Random(2)
    nodes = [f"n{k:03}" for k in range(90)]
    folders = ["", "src/core", "src/core/db", "src/core/db", "lib", "lib-2", "src/app_x/app_x", "src"]
    paths = {n: f"{f}/{n}.ts" if (f := rng.choice(folders)) else f"{n}.ts" for n in nodes}
    parts, edges = {}, []
    for k, n in enumerate(nodes[:80]):
        g = k // 5
        parts[n] = nodes[g * 5]
        if k % 5:
            edges.append((nodes[g * 5], n))
        elif g % 3:
            edges.append((nodes[g * 5 - 5], n))  # a chain of three communities
    parts["alone"], paths["alone"] = "alone", "src/solo/alone.ts"
    got = community.community_names(spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame(list(parts.items()), "node string, part string"), spark.createDataFrame(list(paths.items()), "node string, path string"))
    assert {r["node"]: r["name"] for r in got.collect()} == names(edges, parts, paths)


def test_modularity_as_plain(spark):
    edges = planted(9)
    part = {n: n[:4] for e in edges for n in e}
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], EDGES)
    got = graph.modularity(frame, spark.createDataFrame(list(part.items()), "node string, part string")).first()[0]
    assert got == pytest.approx(quality(edges, part))


def test_queries(spark, monkeypatch):
    """On the smallest tables: connected, as good as the plain version, and named by the rule."""
    import duckdb

    from lodestone.plans import graphs
    from lodestone.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    edges = {(r["source"], r["target"]): r["weight"] for r in graphs.weighted(spark, sf).collect()}
    parts = QUERIES["g_communities"](spark, sf)
    found = {r["node"]: r["part"] for r in parts.collect()}
    assert found == split(edges, found)
    assert quality(edges, found) >= quality(edges, plain(edges)) - 0.01  # no groups in these edges: all ways end in some optimum
    rows = duckdb.execute(f"select p_partkey, p_brand, p_type from '{sf}/part.parquet'").fetchall()
    paths = {f"part_{k:06}": f"src/{b.lower().replace('#', '-')}/{t.lower()}/part_{k:06}.ts" for k, b, t in rows}
    monkeypatch.setattr(graphs.C, "communities", lambda w: parts)  # found once
    got = {r["node"]: r["name"] for r in QUERIES["g_community_names"](spark, sf).collect()}
    assert got == names(edges, found, paths)
