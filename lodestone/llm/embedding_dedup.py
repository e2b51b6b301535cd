"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks.

Normalised vectors are bucketed by quantised random projections in several tables. Within a bucket every
pair is compared by its exact cosine, in blocks of vectors; a pair counts in the first table whose
bucket it shares, so that no pair is counted twice and no pair is ever a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, drop, lists, mix, store
from .components import components

#: Two unit vectors at cosine 0.93 are 0.374 apart. With cells of width 2 one projection puts them in
#: one cell with probability NEAR, and unrelated ones (1.41 apart) with FAR. The more vectors a label
#: has, the more projections a table takes, so that about CHANCE unrelated vectors share a bucket at any
#: size; and so many tables that a pair at the threshold is missed with probability under MISS.
WIDTH, NEAR, FAR, CHANCE, MISS = 2.0, 0.8507, 0.4861, 2.0, 3e-5
#: Vectors of a block that is compared as a whole.
BLOCK = 256


def family_size(vectors: int) -> tuple[int, int]:
    """(projections, tables) for a label of so many vectors: both grow with the logarithm or a small
    power (0.22) of it."""
    projections = max(6, math.ceil(math.log(max(vectors, 1) / CHANCE) / -math.log(FAR)))
    return projections, math.ceil(math.log(MISS) / math.log(1 - NEAR**projections))


@lru_cache(4)
def hash_family(dim: int, projections: int, tables: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dim, tables * projections)), rng.uniform(0, WIDTH, tables * projections)


def buckets(units: np.ndarray, projections: int, tables: int) -> np.ndarray:
    """A 64-bit bucket for each vector and table."""
    a, b = hash_family(units.shape[1], projections, tables)
    out = np.empty((len(units), tables), np.int64)
    for row in range(0, len(units), 512):
        cells = np.floor((units[row : row + 512] @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(-1, tables, projections)
        key = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), cells.shape[:2]).copy()
        for k in range(projections):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
        out[row : row + 512] = key.view(np.int64)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _units(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def close_pairs(units: np.ndarray, cell: np.ndarray, threshold: float, pairs: int = 50_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of one cell whose cosine reaches the threshold; ``cell`` must not fall. Cells of one
    size are compared together, about so many pairs at once; a large one by a product of matrices."""
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.concatenate([begin, [len(cell)]]))
    for size in np.unique(sizes[sizes > 1]):
        starts = begin[sizes == size]
        if size > 32:
            for at in starts:
                own = units[at : at + size]
                a, b = np.nonzero(np.triu(own @ own.T >= threshold, 1))
                yield a + at, b + at
            continue
        one, other = np.triu_indices(size, 1)
        for k in range(0, len(starts), max(1, pairs // len(one))):
            some = starts[k : k + max(1, pairs // len(one)), None]
            a, b = (some + one).ravel(), (some + other).ravel()
            near = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
            yield a[near], b[near]


def _pairs(classes: DataFrame, label: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(cid, links: linked vectors in other classes) and forest edges (u, v) of classes
    (cid, label, n, vector), by bucket and block."""
    largest = classes.groupBy("label").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    family = family_size(largest)

    def hashed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            by_size: dict[int, list[int]] = {}
            for row, size in enumerate(part.column("vector").value_lengths().to_pylist()):
                by_size.setdefault(size, []).append(row)
            for rows in by_size.values():
                some = part.take(pa.array(rows))
                keys = buckets(_units(_matrix(some.column("vector"))), *family)
                yield pa.RecordBatch.from_arrays([some.column("cid"), some.column("label"), lists(list(keys), pa.int64())], ["cid", "label", "keys"])

    keyed = classes.select("cid", "label", "vector").mapInArrow(hashed, f"cid binary, label {label}, keys array<bigint>")
    where = store(keyed.select("cid", "label", F.posexplode("keys").alias("table", "key")), "buckets")
    counts = where.groupBy("label", "table", "key").agg(F.count("*").alias("c")).where("c > 1")
    dealt = where.join(counts, ["label", "table", "key"]).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    # in a bucket of several blocks, each block meets itself and the later ones
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("x"), F.greatest(k, F.col("block")).alias("y")))
    rows = dealt.select("cid", "label", "table", "key", "block", F.explode(meets).alias("at")).select("cid", "label", "table", "key", "block", "at.*")
    rows = rows.join(classes.select("cid", "n", "vector"), "cid")
    cells = rows.groupBy("label", "table", "key", "x", "y").agg(F.collect_list(F.struct("cid", "block", "n", "vector")).alias("rows"))

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cells = part.column("rows")
            values, sizes = cells.values, np.diff(cells.offsets.to_numpy())
            cell = np.repeat(np.arange(len(sizes)), sizes)
            table = part.column("table").to_numpy(zero_copy_only=False)
            apart = (part.column("x").to_numpy(zero_copy_only=False) != part.column("y").to_numpy(zero_copy_only=False))[cell]
            block, n = (values.field(c).to_numpy(zero_copy_only=False) for c in ("block", "n"))
            lengths = values.field("vector").value_lengths().to_numpy(zero_copy_only=False)
            links, group = np.zeros(len(cell), np.int64), np.arange(len(cell))
            for length in np.unique(lengths):  # vectors of one length
                mine = np.flatnonzero(lengths == length)
                units = _units(_matrix(values.field("vector").take(pa.array(mine))))
                for a, b in close_pairs(units, cell[mine], threshold):
                    i, j = mine[a], mine[b]
                    # pairs within a block are counted where it meets itself
                    good = ~apart[i] | (block[i] != block[j])
                    a, b, i, j = a[good], b[good], i[good], j[good]
                    for k in range(0, len(a), 8192):
                        at = slice(k, k + 8192)
                        met, back = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
                        keys = buckets(units[met], *family)
                        half = len(back) // 2
                        before = np.arange(keys.shape[1]) < table[cell[i[at]]][:, None]
                        first = ~((keys[back[:half]] == keys[back[half:]]) & before).any(axis=1)
                        x, y = i[at][first], j[at][first]
                        np.add.at(links, x, n[y])
                        np.add.at(links, y, n[x])
                        while len(x):  # the least member of each component, by spreading minima
                            low = np.minimum(group[x], group[y])
                            if (group[x] == low).all() and (group[y] == low).all():
                                break
                            for end in (x, y, group[x], group[y]):
                                np.minimum.at(group, end, low)
            while (group[group] != group).any():
                group = group[group]
            rows = np.flatnonzero(links)
            star = np.flatnonzero(group != np.arange(len(group)))
            ids = values.field("cid")
            u = pa.concat_arrays([ids.take(pa.array(rows)), ids.take(pa.array(star))])
            v = pa.concat_arrays([pa.nulls(len(rows), pa.binary()), ids.take(pa.array(group[star]))])
            yield pa.RecordBatch.from_arrays([u, v, pa.array(np.concatenate([links[rows], np.zeros(len(star), np.int64)]))], ["u", "v", "links"])

    found = store(cells.select("table", "x", "y", "rows").mapInArrow(compare, "u binary, v binary, links bigint"), "found")
    drop(where)
    return found.where("v is null").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links")), found.where("v is not null").select("u", "v")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per input row: id_col, n_links, component_id, kept.

    Vectors of equal, non-null labels are linked where their cosine in double precision is at least
    ``threshold``; n_links counts the other vectors linked directly, component_id is the smallest id
    reachable, kept is id = component_id. Equal vectors of a label are one class from the start, so
    copies are never expanded into pairs; vectors of different lengths are never compared.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows without a
    label, link with nothing. Repeated ids are rows of their own. A null id names no component. Other
    columns are not read. An empty table gives an empty result.
    """
    batches(rows.sparkSession)
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    base = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(F.col("label").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    # adding 0.0 makes negative zeros equal to positive ones
    plain = F.transform("vector", lambda x: x + F.lit(0.0).cast("float" if single else "double"))
    base = base.withColumn("good", good).withColumn("vector", plain)
    key = F.substring(F.unhex(F.sha2(F.to_json(F.struct("label", "vector")), 256)), 1, 16)
    keyed = base.select("id", F.when(F.col("good"), key).alias("ck"), "label", "vector")
    classes = keyed.where("ck is not null").groupBy("ck").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = store(classes.withColumnRenamed("ck", "cid"), "classes")
    links, edges = _pairs(classes, rows.schema[label_col].dataType.simpleString(), threshold)
    roots = components(edges)
    named = classes.select("cid", "id", "n").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(least, "root").join(links, "cid", "left").select(F.col("cid").alias("ck"), "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = keyed.select("id", "ck").join(named, "ck", "left")
    component = F.when(F.col("ck").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.col("id").isNull() & component.isNull()).alias("kept"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors, label by label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
with v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as u, b.vec_id as v from v a join v b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  and list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (
  with recursive r(u, v) as (select u, v from links union select r.u, l.v from r join links l on r.v = l.u)
  select u, min(v) as least from r group by u),
counted as (select u, count(*) as n_links from links group by u)
select e.vec_id, coalesce(c.n_links, 0)::bigint as n_links,
       least(e.vec_id, coalesce(r.least, e.vec_id)) as component_id,
       e.vec_id = least(e.vec_id, coalesce(r.least, e.vec_id)) as kept
from embeddings e left join counted c on c.u = e.vec_id left join reach r on r.u = e.vec_id
"""
