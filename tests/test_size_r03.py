"""Plans and kernels that larger tables need, on small ones."""

import random

from lodestone.operators import graph as G
from lodestone.sources import extract as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paths_are_not_broadcast(spark):
    """Narrow tables make wide paths: their size is no reason to send them to the driver."""
    files = spark.range(100).selectExpr("concat('src/', id, '.ts') as file_path")
    found = X.resolve(files.selectExpr("file_path", "'./7.js' as specifier"), files)
    assert "Broadcast" not in plan(found)
    assert {r["target"] for r in found.collect()} == {"src/7.ts"}


def test_bits_jump_along_single_edges(spark, monkeypatch):
    """Trees into cycles: the bits of all that leads to a node, in rounds by the logarithm of the way."""
    rng = random.Random(3)
    after = {k: k + 1 for k in range(40)} | {40: 30} | {k: rng.choice(range(41)) for k in range(50, 80)}
    seeds = [(rng.choice(list(after)), k % 2, 1 << rng.randrange(4)) for k in range(12)] + [(0, 0, 1 << 40)]
    want: dict = {}
    for node, block, mask in seeds:
        met = set()
        while node is not None and node not in met:
            met.add(node)
            want[node, block] = want.get((node, block), 0) | mask
            node = after.get(node)
    rounds = []
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda *frames: rounds.append(1) or cut(*frames))
    found = G.spread(spark.createDataFrame(list(after.items()), "source long, target long"), spark.createDataFrame(seeds, "node long, block int, mask long"))
    assert {(r["node"], r["block"]): r["mask"] for r in found.collect()} == want
    assert len(rounds) < 24


def test_bits_meet_components_as_one_node(spark, monkeypatch):
    """A large strong component takes each block's bits once, not once for each of its nodes; what leads to it, what it
    leads to, and what is apart keep bits of their own."""
    rng = random.Random(5)
    edges = {(k, (k + 1) % 150) for k in range(150)} | {(rng.randrange(150), rng.randrange(150)) for _ in range(500)}
    edges |= {(200, 3), (200, 201), (7, 210), (210, 211), (210, 212), (300, 301), (301, 300), (301, 302), (9, 9)}
    seeds = [(rng.choice([*range(150), 200, 210, 300]), block, 1 << rng.randrange(62)) for block in range(20) for _ in range(3)]
    want: dict = {}
    for node, block, mask in seeds:
        met, todo = set(), [node]
        while todo:
            at = todo.pop()
            if at not in met:
                met.add(at)
                todo += [b for a, b in edges if a == at]
        for n in met:
            want[n, block] = want.get((n, block), 0) | mask
    frames, cut = [], G.cut

    def counted(df, *done):
        out = cut(df, *done)
        frames.append(out.count() if "mask" in out.columns else 0)
        return out

    monkeypatch.setattr(G, "cut", counted)
    edges_, seeds_ = spark.createDataFrame(list(edges), "source long, target long"), spark.createDataFrame(seeds, "node long, block int, mask long")
    told = lambda found: {(r["node"], r["block"]): r["mask"] for r in found.collect()}
    assert told(G.spread(edges_, seeds_)) == want
    assert sum(frames) < 1000 < len(want)
    wanted = {3, 7, 200, 211, 302, 999}
    assert told(G.spread(edges_, seeds_, spark.createDataFrame([(n,) for n in [*wanted, 3]], "node long"))) == {k: v for k, v in want.items() if k[0] in wanted}


def test_similar_sets_by_classes(spark, tmp_path):
    """Copies are compared once: 400 rows of one set cost a comparison, and all their pairs are told."""
    from lodestone.plans import scalars

    rows = [(k, "b", "red blue tin", "X") for k in range(400)] + [(k, "b", "red blue", f"Y{k % 2} zinc") for k in range(400, 420)] + [(k, "c", "red blue tin", "X") for k in range(420, 425)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    compared = []
    similar, scalars.similar = scalars.similar, lambda a, b, *rest: compared.append(a.join(b, "p_brand").count()) or similar(a, b, *rest)
    try:
        got = {(r["a"], r["b"]): r["score"] for r in scalars.fn_set_similarity(spark, str(tmp_path)).collect()}
    finally:
        scalars.similar = similar
    words = {k: {w for w in f"{name} {kind}".lower().split() if len(w) > 1} for k, _, name, kind in rows}
    score = lambda x, y: len(words[x] & words[y]) / len(words[x] | words[y])
    want = {(x, y): round(score(x, y), 6) for x, bx, *_ in rows for y, by, *_ in rows if x % 20 == 0 and x != y and bx == by and score(x, y) >= 0.5}
    assert got == want and compared[0] <= 10


def test_joint_counts_in_blocks(spark, monkeypatch):
    """Blocks of few members and names give what counting pair by pair gives, a missing member too."""
    from lodestone.operators import retrieval as R

    rng = random.Random(7)
    monkeypatch.setattr(R, "BLOCK", 4)
    sides = [{(f"n{rng.randrange(9)}", rng.choice([None, *"abcdefghijk"])): rng.randrange(1, 5) for _ in range(60)} for _ in range(2)]
    frame = lambda side, who: spark.createDataFrame([(n, w, c) for (n, w), c in side.items()], f"name string, {who} string, n long")
    want: dict = {}
    for (x, a), i in sides[0].items():
        for (y, b), k in sides[1].items():
            if x == y:
                want[a, b] = want.get((a, b), 0) + i * k
    found = R.joint_counts(frame(sides[0], "a"), frame(sides[1], "b"), "name", "a", "b", "n", "pairs")
    assert {(r["a"], r["b"]): r["pairs"] for r in found.collect()} == want
    assert R.joint_counts(frame(sides[0], "a"), frame({}, "b"), "name", "a", "b", "n", "pairs").count() == 0


def test_waiting_changes_are_one_value():
    """The state of a key has a handful of values, however many changes wait."""
    from lodestone.streaming.debounce import Debounce

    d = Debounce(40, 4, None)
    d.waiting = [(k, -k, None if k % 7 == 0 else f"ü{k}") for k in range(1000)]
    held = d.held()
    assert sum(len(x) for x in held if isinstance(x, list)) == 0
    assert Debounce(40, 4, held).waiting == d.waiting


def test_lines_move_once_to_hits(spark):
    """Contexts are read off a document's lines: no shuffle carries a line for each symbol near it."""
    from lodestone.operators.positional import PositionalIndex

    docs = spark.createDataFrame([(1, "aa\nbb\ncc\ndd\nee\nff"), (2, "ff aa\n\nff"), (3, None)], "id long, t string")
    index = PositionalIndex.build(docs, "id", docs["t"])
    found = index.grep(spark.createDataFrame([("ff", 9), ("aa", 2)], "symbol string, defined long"), 1)
    assert sorted(map(tuple, found.select("symbol", "doc", "matches", "first_line", "context").collect())) == [("aa", 1, 1, 1, "aa\nbb"), ("ff", 1, 1, 6, "ee\nff"), ("ff", 2, 2, 1, "ff aa\n\nff")]
    assert "explode" not in plan(found)
