import duckdb
import numpy as np

from lodestone.llm import embedding_dedup as E


def brute(rows, threshold=0.93):
    ok = []
    for _, v, label in rows:
        good = label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, np.float64) if good else None)
    n = len(rows)
    link = [[False] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                link[i][j] = ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= threshold
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = [j for j in range(n) if link[k][j] and j not in seen]
            seen |= set(new)
            todo += new
        out.append((rows[i][0], sum(link[i]), min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)))
    return sorted(out, key=str)


def test_as_brute_force(spark, monkeypatch):
    """Clusters of every tightness, copies, several blocks to a bucket."""
    monkeypatch.setattr(E, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(12):
            v = centre + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2, 0.35])
            rows.append((len(rows), [float(np.float32(x)) for x in v], c % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = E.near_vectors(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_and_sql(spark):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = sorted(con.execute(f"select vec_id, n_links, component_id from ({E.OP9_SQL})").fetchall())
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.op9_embedding_dedup(spark, sf).collect())
    links = sum(n for _, n, _ in want)
    assert sum(n for _, n, _ in got) >= 0.99 * links and len(got) == len(want)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, -0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [3.0, 0.0], 1), (2, [2.0, 0.0], 1), (12, [1e-30, 1e-32], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in E.near_vectors(df).collect()), key=str)
    assert got == brute(rows)
    assert E.near_vectors(df.where("false")).count() == 0


def test_family_grows_slowly():
    """Ten times the vectors: unrelated ones still share few buckets, near ones are still found."""
    for n in (10, 1000, 50_000, 10**7, 10**10):
        projections, tables = E.family_size(n)
        assert n * E.FAR**projections <= E.CHANCE or projections == 6
        assert (1 - E.NEAR**projections) ** tables <= E.MISS
        assert tables <= 60 * (n / 1000) ** 0.25 + 30


def test_clashing_columns(spark):
    rows = [(k, [1.0, float(k == 3)], "a", b"c", 7) for k in range(4)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string, cid binary, n int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect())
    assert got == [("0", 2, "0", True), ("1", 2, "0", False), ("2", 2, "0", False), ("3", 0, "3", True)]
