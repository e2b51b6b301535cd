"""K-means over integer vectors by Yinyang grouping.

Centroids are clustered into groups once. Each vector keeps an upper bound of the distance to its own
centroid and, per group, a lower bound of the distance to all others of the group. After a round's update
the bounds move by how far centroids moved. A vector whose upper bound lies below all lower bounds keeps
its centroid (global filter); else only groups whose bound is not above it are scanned, exactly.

Distances are exact in integers, so ties and results don't depend on the bounds: bounds are floating-point
and widened by more than their rounding, so that no centroid that is as near is ever passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, drop, lists, store

#: Components are kept within this bound, so that squared distances of up to 500 components fit 64 bits.
LIMIT = 1 << 26
#: Relative slack of the bounds: far above the rounding of a few additions, far below any filter's use.
SLACK = 1e-9
STATE = "id {id}, vector array<int>, cluster int, upper double, lower array<double>"


def grouping(centroids: np.ndarray, size: int = 10, rounds: int = 5) -> np.ndarray:
    """The group of each centroid: about ``size`` centroids a group, by a few rounds of k-means over the
    centroids themselves. Only centroids are held."""
    groups = max(1, -(-len(centroids) // size))
    points = centroids.astype(np.float64)
    centres = points[:groups].copy()
    for _ in range(rounds):
        own = ((points[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (own == g).any():
                centres[g] = points[own == g].mean(axis=0)
    return np.unique(own, return_inverse=True)[1]


def squared(vectors: np.ndarray, centroids: np.ndarray, rows: np.ndarray, which: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """Exact squared distances of pairs (row, centroid)."""
    out = np.empty(len(rows), np.int64)
    for k in range(0, len(rows), at_once):
        gap = vectors[rows[k : k + at_once]] - centroids[which[k : k + at_once]]
        out[k : k + at_once] = np.einsum("ij,ij->i", gap, gap)
    return out


class Rounds:
    """One assignment of vectors to ``centroids``; ``moved`` is how far each moved since the last one."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray | None = None):
        self.centroids, self.group, self.moved = centroids, group, moved
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max()) + 1)]
        self.drift = None if moved is None else np.array([moved[m].max() for m in self.members])

    def scan(self, vectors: np.ndarray, own: np.ndarray, exact: np.ndarray, lower: np.ndarray, todo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New (own, exact) where ``todo`` marks the groups that each vector must scan. ``lower`` becomes
        the bounds that hold for the new own."""
        before, before_exact = own.copy(), exact.copy()
        best, best_exact = own.copy(), exact.copy()
        tables = []
        for g, members in enumerate(self.members):
            rows = np.flatnonzero(todo[:, g])
            pairs = squared(vectors, self.centroids, np.repeat(rows, len(members)), np.tile(members, len(rows))).reshape(len(rows), len(members))
            tables.append((rows, pairs))
            if len(rows):
                at = pairs.argmin(axis=1)  # the first of equal ones: members rise
                found, which = pairs[np.arange(len(rows)), at], members[at]
                nearer = (found < best_exact[rows]) | ((found == best_exact[rows]) & (which < best[rows]))
                best[rows[nearer]], best_exact[rows[nearer]] = which[nearer], found[nearer]
        for g, (rows, pairs) in enumerate(tables):
            if len(rows):
                others = np.where(self.members[g][None] == best[rows][:, None], np.iinfo(np.int64).max, pairs).min(axis=1)
                lower[rows, g] = np.where(others == np.iinfo(np.int64).max, np.inf, np.sqrt(others.astype(np.float64)) * (1 - SLACK))
        # the centroid that was left bounds its group, if the group was not scanned
        left = np.flatnonzero(best != before)
        g = self.group[before[left]]
        lower[left, g] = np.where(todo[left, g], lower[left, g], np.minimum(lower[left, g], np.sqrt(before_exact[left].astype(np.float64)) * (1 - SLACK)))
        return best, best_exact

    def first(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own, upper, lower) by scanning all centroids."""
        n = len(vectors)
        own, exact = np.zeros(n, np.int64), squared(vectors, self.centroids, np.arange(n), np.zeros(n, np.int64))
        lower = np.zeros((n, len(self.members)))
        own, exact = self.scan(vectors, own, exact, lower, np.ones((n, len(self.members)), bool))
        return own, np.sqrt(exact.astype(np.float64)) * (1 + SLACK), lower

    def next(self, vectors: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own, upper, lower) after the centroids moved."""
        own, upper = own.copy(), (upper + self.moved[own]) * (1 + SLACK)
        lower = lower - self.drift
        lower -= np.abs(lower, where=np.isfinite(lower), out=np.zeros_like(lower)) * SLACK
        rows = np.flatnonzero(lower.min(axis=1) <= upper)  # global filter
        exact = squared(vectors, self.centroids, rows, own[rows])
        upper[rows] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
        todo = lower[rows] <= upper[rows, None]  # group filter
        some = np.flatnonzero(todo.any(axis=1))
        rows, exact, todo = rows[some], exact[some], todo[some]
        bounds = lower[rows]
        own[rows], exact = self.scan(vectors[rows], own[rows], exact, bounds, todo)
        lower[rows], upper[rows] = bounds, np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
        return own, upper, lower


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _assigned(state: DataFrame, rounds: Rounds, id_type: str) -> DataFrame:
    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not len(part):
                continue
            vectors = _matrix(part.column("vector"), np.int64)
            if rounds.moved is None:
                own, upper, lower = rounds.first(vectors)
            else:
                own, upper, lower = rounds.next(vectors, part.column("cluster").to_numpy().astype(np.int64), part.column("upper").to_numpy(), _matrix(part.column("lower"), np.float64))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), pa.array(own, pa.int32()), pa.array(upper), lists(list(lower), pa.float64())], ["id", "vector", "cluster", "upper", "lower"])

    return state.mapInArrow(assign, STATE.format(id=id_type))


def _updated(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each non-empty cluster's componentwise floor of the mean, exactly. Sums are made per batch before
    anything is shuffled; clusters times components come to the driver."""
    k, dim = centroids.shape

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = part.column("cluster").to_numpy()
            total = np.zeros((k, dim + 1), np.int64)
            np.add.at(total, own, np.column_stack([_matrix(part.column("vector"), np.int64), np.ones(len(own), np.int64)]) if len(own) else np.zeros((0, dim + 1), np.int64))
            some = np.flatnonzero(total[:, dim])
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), lists(list(total[some]), pa.int64())], ["cluster", "sums"])

    partial = state.select("cluster", "vector").mapInArrow(sums, "cluster int, sums array<bigint>")
    totals = partial.select("cluster", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    table: dict[int, dict[int, int]] = {}
    for row in totals.collect():  # clusters x components
        table.setdefault(row["cluster"], {})[row["place"]] = int(row["s"])
    out = centroids.copy()
    for cluster, places in table.items():
        out[cluster] = [places[i] // places[dim] for i in range(dim)]
    return out


def kept_vectors(rows: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """(id, vector) of the rows whose vector has ``dim`` components, none null or non-finite; each
    component is floor(scale * x), within LIMIT."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = F.coalesce((F.size(x) == dim) & finite, F.lit(False))
    whole = F.transform(x, lambda v: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.greatest(F.lit(-2.0 * LIMIT), F.least(F.lit(2.0 * LIMIT), v * scale))))).cast("int"))
    return rows.where(good).select(F.col(id_col).alias("id"), whole.alias("vector"))


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(assignment, centroids): rows id_col, cluster, distance, and the final centroids.

    Centroids start as the k vectors with the least sha256 of ``seed:id``, in that order (equal hashes by
    vector; null ids are never chosen, but where no other vector is left). Each round assigns every vector
    to its nearest centroid (ties: smaller number) and replaces every non-empty centroid by the floor of
    its vectors' mean; then vectors are assigned once more. With fewer vectors than k, there are as many
    centroids. Repeated ids are vectors of their own. Vectors with another number of components, or with
    null or non-finite ones, and null vectors are left out. Other columns are not read; an empty table
    gives an empty result.
    """
    spark = rows.sparkSession
    batches(spark)
    id_type = rows.schema[id_col].dataType.simpleString()
    state = store(kept_vectors(rows, id_col, vector_col, dim, scale), "vectors")
    hashed = state.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    seeds = [r["vector"] for r in hashed.orderBy(F.col("h").asc_nulls_last(), "vector").limit(k).select("vector").collect()]
    if not seeds:
        return state.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, dim), np.int64)
    centroids = np.array(seeds, np.int64)
    group, moved = grouping(centroids), None
    for _ in range(rounds):
        last = state
        state = store(_assigned(last, Rounds(centroids, group, moved), id_type), "assigned")
        drop(last)
        new = _updated(state, centroids)
        gap = (new - centroids).astype(np.float64)
        centroids, moved = new, np.sqrt((gap * gap).sum(axis=1)) * (1 + SLACK)
    last = state
    final = Rounds(centroids, group, moved)

    def measured(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = part.column("cluster").to_numpy().astype(np.int64)
            exact = squared(_matrix(part.column("vector"), np.int64), final.centroids, np.arange(len(own)), own) if len(own) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("cluster"), pa.array(exact)], [id_col, "cluster", "distance"])

    found = _assigned(last, final, id_type).select("id", "vector", "cluster").mapInArrow(measured, f"`{id_col}` {id_type}, cluster int, distance bigint")
    found = store(found, "clusters")
    drop(last)
    return found, centroids


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 40 clusters after 5 rounds, with inertia and digests of the centroids."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    whole = found.agg(F.sum("distance")).first()[0]
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")


def _round_sql(n: int, update: bool) -> str:
    near = f"""
near{n} as materialized (
  select id, arg_min(c, (d, c)) as c, min(d) as d from (
    select v.id, m.c, sum((v.x - m.x) * (v.x - m.x)) as d from parts v join centroids{n} m using (i) group by v.id, m.c)
  group by id)"""
    if not update:
        return near
    return f"""{near},
sums{n} as (select n.c, v.i, sum(v.x)::bigint as s, count(*)::bigint as m from near{n} n join parts v using (id) group by n.c, v.i),
centroids{n + 1} as materialized (
  select m.c, m.i, coalesce((s.s - ((s.s % s.m) + s.m) % s.m) // s.m, m.x) as x from centroids{n} m left join sums{n} s using (c, i))"""


OP12_SQL = f"""
with kept as materialized (
  select row_number() over () as id, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select id, unnest(v) as x, generate_subscripts(v, 1) as i from kept),
chosen as (select id, row_number() over (order by sha256('2:' || vec_id::varchar), v) - 1 as c from kept),
centroids0 as materialized (select c.c, p.i, p.x from chosen c join parts p using (id) where c.c < 40),
{",".join(_round_sql(n, n < 5) for n in range(6))},
digests as (select c, sha256(string_agg(x::varchar, ',' order by i)) as centroid_sha256 from centroids5 group by c)
select k.vec_id, n.c::int as cluster, n.d::bigint as distance, (sum(n.d) over (partition by n.c))::bigint as cluster_inertia,
       (sum(n.d) over ())::bigint as inertia, g.centroid_sha256
from near5 n join kept k using (id) join digests g on g.c = n.c
"""
