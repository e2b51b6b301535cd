"""Ranked retrieval: BM25, vectors, rank fusion, set similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard

K1, B = 1.2, 0.75
RRF_K = 60


def bm25(rows: DataFrame) -> DataFrame:
    """(doc, score) from (doc, term, tf, dl, df, n, avgdl)."""
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(1e-6)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("doc").agg((-F.sum(part)).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nearest(rows: DataFrame, id_col: str, vector_col: str, query: DataFrame, k: int) -> DataFrame:
    """The k nearest rows by Euclidean distance to the one vector of ``query`` (column q)."""
    near = rows.join(F.broadcast(query.limit(1))).select(F.col(id_col).alias("id"), distance(F.col(vector_col), F.col("q")).alias("distance"))
    return near.orderBy("distance", "id").limit(k)


def nearest_all(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int, metric: str = "distance", key: str | None = None, block: int = 2048) -> DataFrame:
    """(query, id, value): for each query vector its k best rows, itself left out; by Euclidean distance
    or, with ``metric="cosine"``, by cosine; ties to the smaller id. With ``key``, among rows of equal key.

    All rows meet all queries, block by block: a block of rows and a block of queries are two matrices,
    and only the k best of each query leave a task.
    """
    spark = rows.sparkSession
    named = lambda df: df.select((F.col(key) if key else F.lit(0)).alias("g"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null and g is not null")
    count = lambda df: df.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    deal = lambda df: df.withColumn("b", F.pmod(F.xxhash64("id"), "n").cast("int"))
    q, r = named(queries), named(rows)
    asked = count(q)
    q = deal(q.join(asked, "g")).groupBy("g", "b").agg(F.collect_list(F.struct("id", "v")).alias("qs"))
    r = deal(r.join(count(r), "g")).groupBy("g", F.col("b").alias("rb")).agg(F.collect_list(F.struct("id", "v")).alias("rs"))
    met = r.join(asked, "g").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).join(q, ["g", "b"])
    kind = rows.schema[id_col].dataType.simpleString()

    def best(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for qs, rs in zip(part.column("qs"), part.column("rs"), strict=True):
                qi, ri = qs.values.field("id"), rs.values.field("id")
                a = np.array(qs.values.field("v").to_pylist(), np.float64)
                b = np.array(rs.values.field("v").to_pylist(), np.float64)
                order = np.argsort(np.array(ri.to_pylist()), kind="stable")
                b, ri = b[order], ri.take(pa.array(order))
                if metric == "cosine":
                    value = (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
                    rank = -value
                else:
                    rank = value = np.stack([np.sqrt(((b - row) ** 2).sum(axis=1)) for row in a])
                rank = np.where(np.array(qi.to_pylist())[:, None] == np.array(ri.to_pylist())[None, :], np.inf, rank)
                top = np.argsort(rank, axis=1, kind="stable")[:, : min(k, len(b))]
                row = np.repeat(np.arange(len(a)), top.shape[1])
                top = top.ravel()
                good = np.isfinite(rank[row, top])
                row, top = row[good], top[good]
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(row)), ri.take(pa.array(top)), pa.array(value[row, top])], ["query", "id", "value"])

    found = met.select("qs", "rs").mapInArrow(best, f"query {kind}, id {kind}, value double")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("value") if metric == "cosine" else F.asc("value"), "id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def rrf(ranked: list[DataFrame], normalise: bool = False) -> DataFrame:
    """Reciprocal-rank fusion of frames (id, rank): sum of 1 / (60 + rank)."""
    rows = ranked[0].select("id", "rank")
    for other in ranked[1:]:
        rows = rows.unionByName(other.select("id", "rank"))
    out = rows.groupBy("id").agg(F.sum(1 / (F.lit(RRF_K) + F.col("rank"))).alias("score"))
    if normalise:
        top = out.agg(F.max("score").alias("top"))  # one row
        out = out.crossJoin(F.broadcast(top)).select("id", (F.col("score") / F.col("top")).alias("score"))
    return out


def ranks(rows: DataFrame, part: str, score: Column, *ties: str) -> DataFrame:
    """``rows`` with their rank by (score, ties) among those of equal ``part``.

    Scores are dealt to bands; a row's rank is the number of rows in the bands before its own and its
    place within. Only the bands' counts are ordered in one place, so a part of any size is spread.
    """
    rows = rows.withColumn("__band", F.floor(score * 64))
    counts = rows.groupBy(part, "__band").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(part).orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(counts.select(part, "__band", before.alias("__before")), [part, "__band"])
    place = F.row_number().over(Window.partitionBy(part, "__band").orderBy(score, *ties))
    return placed.withColumn("rank", (F.col("__before") + place).cast("int")).drop("__band", "__before")


def with_rank(rows: DataFrame, *order: Column | str) -> DataFrame:
    """A 1-based rank in a total order; for bounded results."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def similar_to(rows: DataFrame, id_col: str, tokens_col: str, seed: DataFrame, least: float) -> DataFrame:
    """Rows whose token sets are similar to the one of ``seed`` (columns seed_id, seed_tokens)."""
    out = rows.join(F.broadcast(seed.limit(1))).where(F.col(id_col) != F.col("seed_id"))
    return out.select(F.col(id_col).alias("id"), jaccard(F.col(tokens_col), F.col("seed_tokens")).alias("score")).where(F.col("score") >= least)


def similar(a: DataFrame, b: DataFrame, key: str, left: str, right: str, least: float) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` with equal ``key`` whose sets ``left`` and ``right`` (arrays without repeats) have
    a Jaccard similarity (``score``) of ``least`` or more.

    A set's signature has a bit for each element's hash. What only one of two signatures has, only one of the sets
    has: that bounds what they share, so most pairs are dropped by two numbers and none that counts is."""
    bits = lambda c: F.expr(f"aggregate({c}, 0L, (m, x) -> m | shiftleft(1L, cast(pmod(xxhash64(x), 64) as int)))")
    a = a.select("*", bits(left).alias("__a"), F.size(left).alias("__na"))
    b = b.repartition(4 * b.sparkSession.sparkContext.defaultParallelism, *b.columns).select("*", bits(right).alias("__b"), F.size(right).alias("__nb"))
    alone = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(F.col(y))))
    shared = F.least(F.col("__na") - alone("__a", "__b"), F.col("__nb") - alone("__b", "__a"))
    pairs = a.join(b, key).where(shared * (1 + least) >= least * (F.col("__na") + F.col("__nb")) - 1e-9)
    return pairs.drop("__a", "__na", "__b", "__nb").withColumn("score", jaccard(F.col(left), F.col(right))).where(F.col("score") >= least)


#: Members of either side that a block of joint counts has, about, and names that it takes at once.
BLOCK, NAMES = 1000, 4096


def _products(left: pa.Table, right: pa.Table, name: str, a: str, b: str, n: str, out: str) -> pa.Table:
    """(a, b, out) of one block: the matrix product of its counts, but for zeros."""
    sides = []
    for rows, who in ((left, a), (right, b)):
        who = rows.column(who).combine_chunks().dictionary_encode(null_encoding="encode")
        sides.append((who.indices.to_numpy(zero_copy_only=False), who.dictionary, rows.column(name).to_numpy(), rows.column(n).to_numpy()))
    known = np.intersect1d(sides[0][2].astype(str), sides[1][2].astype(str))
    most = float(sides[0][3].sum()) * float(sides[1][3].sum()) if left.num_rows and right.num_rows else 0
    kind = np.float64 if most < 2**53 else np.int64
    total = np.zeros((len(sides[0][1]), len(sides[1][1])), kind)
    for at in range(0, len(known), NAMES):
        some = known[at : at + NAMES]
        dense = []
        for index, who, names, count in sides:
            place = np.minimum(np.searchsorted(some, names.astype(str)), len(some) - 1)
            hit = some[place] == names.astype(str)
            m = np.zeros((len(who), len(some)), kind)
            m[index[hit], place[hit]] = count[hit]
            dense.append(m)
        total += dense[0] @ dense[1].T
    i, k = np.nonzero(total)
    return pa.table({a: sides[0][1].take(pa.array(i)), b: sides[1][1].take(pa.array(k)), out: pa.array(total[i, k].astype(np.int64))})


def joint_counts(left: DataFrame, right: DataFrame, name: str, a: str, b: str, n: str, out: str) -> DataFrame:
    """(a, b, out): over the names that both have, the sum of the products of their counts; of (name, a, n) and
    (name, b, n), a row for each name and member. No row for pairs without a name in common.

    Members are dealt to blocks by hash. Each block of one side meets each of the other in a matrix product, so
    that nothing is sorted or added up over pairs, which are most of the work."""
    blocks = [max(1, -(-side.select(who).distinct().count() // BLOCK)) for side, who in ((left, a), (right, b))]
    deal = lambda side, who, own, other, size: side.withColumn(own, F.pmod(F.xxhash64(who), F.lit(size[0]))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size[1] - 1).cast("long"))))
    one, two = deal(left, a, "__a", "__b", blocks), deal(right, b, "__b", "__a", blocks[::-1])
    met = one.groupBy("__a", "__b").cogroup(two.groupBy("__a", "__b"))
    return met.applyInArrow(lambda x, y: _products(x, y, name, a, b, n, out), f"{a} {left.schema[a].dataType.simpleString()}, {b} {right.schema[b].dataType.simpleString()}, {out} bigint")
