"""Near-duplicate documents by MinHash.

Minima of many universal hashes over word shingles are banded; documents that share a band are
candidates, signatures drop the hopeless ones, the full sets confirm a link, and components come from
alternating large-star and small-star.

Documents with equal shingle sets are one class from the start. Within a band's bucket each class is
compared with the smallest class only; where the links so found leave a bucket with several
components, those components are compared as well, in blocks. So no link that could join two components
is lost, and no bucket emits its pairs as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, drop, lists, mix, store
from .components import components

#: Minima of a signature, and bands of four minima. A pair at similarity 0.8 shares no band with
#: probability (1 - 0.8**4)**32 < 5e-8.
PERMS, BANDS = 128, 32
#: A pair is confirmed on full sets unless its signatures agree this much less often than the
#: threshold: 0.2 is 5.6 standard deviations at 0.8 (chance under 2e-8).
SLACK = 0.2
#: Classes, and shingles in all, of a block that is compared as a whole.
BLOCK, BLOCK_SHINGLES = 128, 400_000


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    A-Z are lower-cased; words are runs without ASCII white space (space, 0x09 to 0x0D). A text with
    fewer words than a shingle has one: all its words. Without words the set is empty.
    """
    found = text.lower().split()
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=words)] if found else [], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    last = len(found) - words + 1
    total = each[:last].copy()
    for k in range(1, words):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += each[k : k + last]
    return np.unique(mix(total))


def universal(perms: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of the multiply-shift hashes."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 63, (2, perms, 1), np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 2048) -> np.ndarray:
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for k in range(0, len(hashes), block):
        h = a * hashes[k : k + block]
        h += b
        np.minimum(out, h.min(axis=1) >> np.uint64(32), out=out)
    return out.astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, perms: int = PERMS) -> DataFrame:
    """(id, n, ck, sig): set size, 128-bit key of the set, minima. Empty sets have null ck and sig."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = universal(perms)
        for part in parts:
            sizes, keys, sigs = [], [], []
            for text in part.column("text").to_pylist():
                got = shingle_hashes(text or b"", words)
                sizes.append(len(got))
                keys.append(xxhash.xxh3_128_digest(got.tobytes()) if len(got) else None)
                sigs.append(minima(got, a, b) if len(got) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), lists(sigs, pa.int32())], ["id", "n", "ck", "sig"])

    batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n bigint, ck binary, sig array<int>")


def full_sets(docs: DataFrame, id_col: str, text_col: str, words: int, wanted: DataFrame) -> DataFrame:
    """(ck, set) of the classes in ``wanted`` (id, ck), from the texts of one document each."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [shingle_hashes(text or b"", words) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in got], pa.binary()), lists([x.view(np.int64) for x in got], pa.int64())], ["ck", "set"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.join(wanted.select(F.col("id").alias("wid")).distinct(), F.col("id").eqNullSafe(F.col("wid")), "left_semi")
    return rows.select("text").mapInArrow(run, "ck binary, set array<bigint>").dropDuplicates(["ck"])


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, perms: int) -> DataFrame:
    """Those of the pairs (u, v) of classes whose sets are similar enough."""
    sig = classes.select("ck", "n", "sig")
    rated = (
        pairs.join(sig.select(F.col("ck").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su")), "u")
        .join(sig.select(F.col("ck").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv")), "v")
        .where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
        .where(F.size(F.filter(F.zip_with("su", "sv", lambda x, y: x == y), lambda x: x)) >= (percent / 100 - SLACK) * perms)
        .select("u", "v", "nu", "nv")
    )
    rated = store(rated, "rated")
    ends = rated.select(F.col("u").alias("ck")).unionByName(rated.select(F.col("v").alias("ck"))).distinct()
    sets = store(full_sets(docs, id_col, text_col, words, classes.join(ends, "ck", "left_semi").select("id", "ck")), "sets")
    shared = F.size(F.array_intersect("a", "b"))
    links = (
        rated.join(sets.select(F.col("ck").alias("u"), F.col("set").alias("a")), "u")
        .join(sets.select(F.col("ck").alias("v"), F.col("set").alias("b")), "v")
        .withColumn("both", shared.cast("long"))
        .where(F.col("both") * 100 >= (F.col("nu") + F.col("nv") - F.col("both")) * percent)
        .select("u", "v")
    )
    links = store(links, "links")
    drop(rated, sets)
    return links


def block_links(percent: int):
    """Rows of two blocks of classes -> links (u, v) between different components, one for each
    class of the first block and component of the second."""

    def read(cell: pa.Scalar) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        values = cell.values
        sets = values.field("set")
        ends = sets.offsets.to_numpy()
        flat = sets.values.to_numpy(zero_copy_only=False)
        return values.field("ck").to_pylist(), np.array(values.field("root").to_pylist(), object), ends[:-1], np.diff(ends), flat

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple[bytes, bytes]] = []
            for a, b in zip(part.column("xs"), part.column("ys"), strict=True):
                ua, ra, sa, na, fa = read(a)
                ub, rb, sb, nb, fb = read(b)
                # shingles of the first block that the second has too, as columns of 0-1 matrices
                flat_a = np.concatenate([fa[k : k + n] for k, n in zip(sa, na, strict=True)])
                flat_b = np.concatenate([fb[k : k + n] for k, n in zip(sb, nb, strict=True)])
                shared = np.intersect1d(flat_a, flat_b)
                both = np.zeros((len(ua), len(ub)), np.int64)
                row_a, row_b = np.repeat(np.arange(len(ua)), na), np.repeat(np.arange(len(ub)), nb)
                col_a, col_b = np.searchsorted(shared, flat_a), np.searchsorted(shared, flat_b)
                in_a = np.append(shared, 0)[col_a] == flat_a if len(shared) else np.zeros(len(flat_a), bool)
                in_b = np.append(shared, 0)[col_b] == flat_b if len(shared) else np.zeros(len(flat_b), bool)
                in_a, in_b = in_a & (col_a < len(shared)), in_b & (col_b < len(shared))
                for k in range(0, len(shared), 4096):
                    ma, mb = np.zeros((len(ua), 4096), np.float32), np.zeros((len(ub), 4096), np.float32)
                    pick = in_a & (col_a >= k) & (col_a < k + 4096)
                    ma[row_a[pick], col_a[pick] - k] = 1
                    pick = in_b & (col_b >= k) & (col_b < k + 4096)
                    mb[row_b[pick], col_b[pick] - k] = 1
                    both += (ma @ mb.T).astype(np.int64)
                ok = (100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (ra[:, None] != rb[None, :])
                seen = set()
                for x, y in zip(*np.nonzero(ok), strict=True):
                    if (x, rb[y]) not in seen:
                        seen.add((x, rb[y]))
                        out.append((ua[x], ub[y]))
            u, v = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], ["u", "v"])

    return run


def _across(members: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Links between components that share a bucket, exactly.

    In each such bucket one component is the main one, by members. Classes outside it are compared
    with it and with each other; those of all buckets with one main component meet at once, in blocks
    of at most about BLOCK classes and BLOCK_SHINGLES shingles (or one class), so that no pair is ever a
    row and no block pair exceeds a task. Classes are dealt to blocks by size: a class of so many
    shingles that few fit a block meets others in blocks of its own kind.
    """
    placed = members.select("key", "ck").join(roots.select(F.col("node").alias("ck"), "root"), "ck", "left").select("key", "ck", F.coalesce("root", "ck").alias("root"))
    each = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    mixed = each.groupBy("key").agg(F.count("*").alias("kinds"), F.max(F.struct("c", "root")).alias("main")).where("kinds > 1").select("key", F.col("main.root").alias("main"))
    met = placed.join(mixed, "key").select("main", "ck", "root").distinct().withColumn("inside", F.col("root") == F.col("main"))
    met = store(met, "met")
    # classes of one size, to a factor of two, share blocks; so many to a block as fit
    met_sizes = met.join(classes.select("ck", "n"), "ck").withColumn("scale", F.ceil(F.log2("n")).cast("int"))
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.lit(BLOCK_SHINGLES) / F.pow(F.lit(2), "scale")))
    counts = met_sizes.groupBy("main", "inside", "scale").agg(F.ceil(F.count("*") / F.first(room)).cast("int").alias("blocks"))
    deal = F.pmod(F.xxhash64("ck"), "blocks").cast("int").cast("string")
    dealt = met_sizes.join(counts, ["main", "inside", "scale"]).withColumn("block", F.concat_ws(".", F.lpad(F.col("scale").cast("string"), 2, "0"), deal))
    dealt = dealt.select("main", "inside", "block", "ck", "root")
    wanted = classes.join(met.select("ck").distinct(), "ck", "left_semi").select("id", "ck")
    sets = full_sets(docs, id_col, text_col, words, wanted)
    blocks = dealt.join(sets, "ck").groupBy("main", "inside", "block").agg(F.collect_list(F.struct("ck", "root", "set")).alias("rows"))
    blocks = store(blocks, "blocks")
    ends = blocks.select("main", "inside", "block")
    pairs = ends.where("not inside").select("main", F.col("block").alias("x")).join(ends.select("main", F.col("inside").alias("i"), F.col("block").alias("y")), "main").where("i or x <= y")
    xs = blocks.where("not inside").select("main", F.col("block").alias("x"), F.col("rows").alias("xs"))
    ys = blocks.select("main", F.col("inside").alias("i"), F.col("block").alias("y"), F.col("rows").alias("ys"))
    found = store(pairs.join(xs, ["main", "x"]).join(ys, ["main", "i", "y"]).select("xs", "ys").mapInArrow(block_links(percent), "u binary, v binary"), "across")
    drop(met, blocks)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, perms: int = PERMS, bands: int = BANDS) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets.
    component_id is the smallest id reachable by links, itself included; kept is id = component_id.

    Null or empty texts, and texts without words, have no shingles and are linked with nothing.
    A row whose id is null never names a component: alone it has a null component_id and is kept,
    in a group it is not kept. Rows that repeat an id get the same answer each. Other columns of the
    input are not read. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    made = store(signatures(docs, id_col, text_col, words, perms), "signatures")
    classes = store(
        made.where("ck is not null").groupBy("ck").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")),
        "classes",
    )
    step = perms // bands
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, F.slice("sig", k * step + 1, step)))
    buckets = classes.select("ck", F.explode(band).alias("key"))
    first = buckets.groupBy("key").agg(F.min("ck").alias("v"), F.count("*").alias("c")).where("c > 1").select("key", "v")
    members = store(buckets.join(first, "key"), "members")
    pairs = members.where("ck <> v").select(F.col("ck").alias("u"), "v").distinct()
    links = _confirmed(pairs, classes, docs, id_col, text_col, words, percent, perms)
    roots = components(links)

    more = _across(members, roots, classes, docs, id_col, text_col, words, percent)
    if not more.isEmpty():
        # the first components' stars stand for the links that made them
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))

    smallest = roots.join(classes.select(F.col("ck").alias("node"), "id"), "node")
    smallest = smallest.join(smallest.groupBy("root").agg(F.min("id").alias("least")), "root").select(F.col("node").alias("ck"), "least", F.lit(True).alias("linked"))
    named = classes.select("ck", "id").join(smallest, "ck", "left").select("ck", F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("component_id"))
    alone = F.col("ck").isNull()
    out = made.select("id", "n", "ck").join(named, "ck", "left")
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.col("id").isNull() & component.isNull()).alias("kept"),
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
