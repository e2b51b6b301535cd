"""Yinyang clustering against plain k-means in integers, its bounds, its SQL, and edges."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from lodestone.llm.clustering import LIMIT, OP12_SQL, Rounds, cluster, grouping, op12_clustering

SCHEMA = "vec_id long, embedding array<double>, note string"


def plain(rows, k, rounds, dim, scale=256, seed=2):
    """Plain k-means: (id, cluster, distance) and centroids."""
    kept = [(i, [max(-LIMIT, min(LIMIT, math.floor(scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        new = []
        for j, old in enumerate(centroids):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            new.append([sum(c) // len(mine) for c in zip(*mine)] if mine else old)
        centroids = new
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), centroids


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_plain_kmeans(spark, seed):
    rng = np.random.default_rng(seed)
    dim, centres = 6, rng.normal(size=(7, 6))
    rows = [(k, (centres[rng.integers(7)] + rng.normal(size=dim) * 0.2).round(2).tolist()) for k in range(300)]
    rows += [(k, rows[0][1]) for k in range(300, 380)]  # copies, and ties between equal centroids
    rows += [(7, rows[3][1]), (None, rows[4][1]), (400, None), (401, [1.0]), (402, [math.nan] * dim), (403, [None] * dim), (404, [math.inf] * dim), (405, [1e300] * dim)]
    found, centroids = cluster(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), k=23, rounds=6, dim=dim)
    want, means = plain(rows, 23, 6, dim)
    assert sorted(map(tuple, found.collect()), key=str) == want
    assert centroids.tolist() == means


def test_bounds_hold_and_spare_work():
    """After each round no bound is crossed, and most distances are never computed."""
    rng = np.random.default_rng(9)
    vectors = (rng.normal(size=(40, 8))[rng.integers(40, size=4000)] * 400 + rng.normal(size=(4000, 8)) * 20).astype(np.int64)
    centroids = vectors[:40].copy()
    group, moved = grouping(centroids), None
    own = upper = lower = None
    for _ in range(8):
        step = Rounds(centroids, group, moved)
        own, upper, lower = step.first(vectors) if moved is None else step.next(vectors, own, upper, lower)
        exact = ((vectors[:, None] - centroids) ** 2).sum(axis=2)
        assert (own == exact.argmin(axis=1)).all()
        root = np.sqrt(exact)
        assert (root[np.arange(len(own)), own] <= upper).all()
        for g, members in enumerate(step.members):
            others = np.where(members[None] == own[:, None], np.inf, root[:, members])
            assert (lower[:, g] <= others.min(axis=1)).all()
        new = np.array([vectors[own == c].sum(axis=0) // (own == c).sum() if (own == c).any() else centroids[c] for c in range(40)])
        moved = np.sqrt(((new - centroids) ** 2).sum(axis=1)) * (1 + 1e-9)
        centroids = new
    scanned = []
    step = Rounds(centroids, group, moved)
    scan = step.scan
    step.scan = lambda *a: (scanned.append(int(a[4].sum())), scan(*a))[1]
    step.next(vectors, own, upper, lower)
    assert sum(scanned) < 0.2 * len(vectors) * len(step.members)


def test_few_and_no_vectors(spark):
    found, centroids = cluster(spark.createDataFrame([(1, [0.5, -0.001], "")], SCHEMA), dim=2)
    assert found.collect()[0][:] == (1, 0, 0) and centroids.tolist() == [[128, -1]]
    assert cluster(spark.createDataFrame([], SCHEMA))[0].count() == 0


def test_query_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    found = op12_clustering(spark, sf)
    cursor = con.execute(OP12_SQL)
    assert [d[0] for d in cursor.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, cursor.fetchall()))
