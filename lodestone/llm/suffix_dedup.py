"""Removal of repeated byte strings by hash-compared suffix sorting.

A string of LENGTH bytes that starts at two places is a repeat. Sorting the suffixes of all texts would
move every byte many times, so suffixes are dealt by content first:

1. Each window of LENGTH bytes has an anchor: the place in it where a GRAM-byte hash is least. Equal
   windows have equal anchors at equal offsets. Consecutive windows with one anchor make a run, the
   bytes they span its hull; only (anchor hash, hull hash, place) leaves the scan. Runs whose anchor
   occurs nowhere else are done with.
2. A hull hash that occurs twice says that the whole hull is a repeat. Adjoining runs of a document that
   repeat one stretch of another are one claim; the claimed bytes are fetched and compared.
3. Different hulls of one anchor may agree in part. Their windows are suffixes of the anchor's group,
   aligned by their offset from the anchor. They are sorted by merging sorted runs; two suffixes are
   compared by the length of their common prefix, found by binary search over prefix polynomial hashes.
   Neighbours that agree in LENGTH bytes are verified byte for byte; they are repeats.
4. A group of more than GROUP different hulls (a passage in thousands of contexts) would be one task's
   work. It is dealt by more content: windows whose offsets lie in one of SPLIT-wide ranges share a core
   of LENGTH - SPLIT + 1 bytes, which is the key of their group; equal stretches are counted as bytes,
   the rest is sorted as before. Where more than GROUP different stretches share even the core, single
   windows are counted, as bytes.

Every removed byte lies in a string whose bytes were compared. No text and no group is ever held whole
in one task but a document being scanned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, drop, lists, mix, new_path, store

LENGTH = 400
#: Bytes of the anchor's hash: about one run for each (LENGTH - GRAM) / 2 bytes.
GRAM = 160
#: Hulls of a group that is sorted in one task; larger groups are dealt by SPLIT offsets at once.
GROUP, SPLIT = 128, 16
#: Bytes of a text scanned at once, and of hulls sorted at once: about 100 and 400 bytes of arrays each.
PIECE, CHUNK = 1 << 18, 1 << 17

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes are replaced by random 64-bit numbers before they enter a polynomial.
LETTERS = np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


class Prefixes:
    """Prefix polynomial hashes (modulo 2**64) of a byte buffer."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Prefixes.powers) < n + 1:
            size = 1 << max(n, 1 << 16).bit_length()
            for name, factor in (("powers", BASE), ("inverses", INVERSE)):
                steps = np.full(size + 1, factor, np.uint64)
                steps[0] = 1
                setattr(Prefixes, name, np.cumprod(steps))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(LETTERS[data] * Prefixes.powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the strings at ``start``; equal strings have equal hashes wherever they are."""
        return (self.sums[start + size] - self.sums[start]) * Prefixes.inverses[start]


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from prefix and suffix minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts that are joined in ``data``; ``ends``: their ends.

    (text's number, first window's place, windows, anchor's offset from it, anchor's hash).
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, empty, empty, empty, np.zeros(0, np.uint64)
    grams = mix(Prefixes(data).of(np.arange(n - GRAM + 1), GRAM))
    # 36 bits of hash, then the place: the leftmost of equals wins, in every copy alike
    packed = (grams >> np.uint64(28) << np.uint64(28)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (least_in_windows(packed, LENGTH - GRAM + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(ends, starts, side="right")
    good = starts + LENGTH <= ends[text]
    key = np.where(good, anchor, -1)
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]))
    stop = np.concatenate([first[1:], [len(key)]])
    real = key[first] >= 0
    first, stop = first[real], stop[real]
    return text[first], first, stop - first, anchor[first] - first, grams[anchor[first]]


def document_key(ident: Column, text: Column) -> Column:
    """128 bits of a digest of id and text."""
    told = F.coalesce(F.concat(F.lit("="), ident.cast("string")), F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.unhex(F.sha2(told, 256)), text), 256)), 1, 16)


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Texts joined up to PIECE bytes; longer ones cut, with LENGTH - 1 bytes of overlap.

    (first text's number, first text's offset, parts).
    """
    at, held, size = 0, [], 0
    for k, data in enumerate(texts):
        if held and size + len(data) > PIECE:
            yield at, 0, held
            held, size = [], 0
        if not held:
            at = k
        if len(data) > PIECE:
            for cut in range(0, len(data) - LENGTH + 1, PIECE):
                yield k, cut, [data[cut : cut + PIECE + LENGTH - 1]]
            at = k + 1
            continue
        held.append(data)
        size += len(data)
    if held:
        yield at, 0, held


RUNS = "doc binary, at bigint, windows int, offset int, anchor bigint, hull binary"


def scan(rows: DataFrame) -> DataFrame:
    """The runs of all documents (doc, text as binary)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, keys = part.column("text").to_pylist(), part.column("doc").to_pylist()
            for first, offset, held in pieces(texts):
                joined = b"".join(held)
                ends = np.cumsum([len(x) for x in held])
                text, at, windows, anchor, grams = runs(np.frombuffer(joined, np.uint8), ends)
                if not len(at):
                    continue
                base = np.concatenate([[0], ends[:-1]])[text]
                view = memoryview(joined)
                hulls = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(at.tolist(), (at + windows + LENGTH - 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[first + t] for t in text.tolist()], pa.binary()), pa.array(at - base + offset), pa.array(windows.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(hulls, pa.binary())],
                    ["doc", "at", "windows", "offset", "anchor", "hull"],
                )

    return rows.select("doc", "text").mapInArrow(run, RUNS)


def common_prefix(hashes: Prefixes, a: np.ndarray, b: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Length, up to ``most``, of the common prefix of the suffixes at ``a`` and ``b``: binary search
    over prefix hashes."""
    low = np.zeros(len(a), np.int64)
    high = np.full(len(a), most, np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high + 1) // 2
        same = hashes.of(a, middle) == hashes.of(b, middle)
        low = np.where(same & open_, middle, low)
        high = np.where(~same & open_, middle - 1, high)


def before(data: np.ndarray, hashes: Prefixes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the suffix at ``a`` sorts before that at ``b``, by their first LENGTH bytes."""
    shared = common_prefix(hashes, a, b)
    full = shared >= LENGTH
    at = np.minimum(shared, LENGTH - 1)
    return ~full & (data[a + at] < data[b + at])


def merge_sort(data: np.ndarray, hashes: Prefixes, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order that sorts suffixes within their groups; ``group`` must not fall.

    Bottom-up mergesort: all pairs of sorted runs of one width are merged at once. A suffix's place in
    the merged run is its place in its own run plus the number of suffixes of the other run before it,
    found by binary search with hash-compared suffixes.
    """
    order = np.arange(len(starts))
    first = np.searchsorted(group, group)  # of each place, where its group begins
    last = np.searchsorted(group, group, side="right")
    place = order - first
    largest = int((last - first).max()) if len(order) else 0
    width = 1
    while width < largest:
        pair = place // (2 * width) * (2 * width)
        right = place - pair >= width
        mid = np.minimum(first + pair + width, last)
        end = np.minimum(first + pair + 2 * width, last)
        busy = np.flatnonzero(mid < end)
        lo = np.where(right, first + pair, mid)[busy]
        hi = np.where(right, mid, end)[busy]
        own = np.where(right, mid, first + pair)[busy]
        here, is_right = starts[order[busy]], right[busy]
        begin = lo.copy()
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            middle = (lo[live] + hi[live]) // 2
            other = starts[order[middle]]
            mine = here[live]
            # equals of the left run stay in front: the sort is stable
            smaller = np.where(is_right[live], ~before(data, hashes, mine, other), before(data, hashes, other, mine))
            lo[live] = np.where(smaller, middle + 1, lo[live])
            hi[live] = np.where(smaller, hi[live], middle)
        target = (first + pair)[busy] + (busy - own) + (lo - begin)
        moved = order.copy()
        moved[target] = order[busy]
        order = moved
        width *= 2
    return order


def repeats(hulls: list[bytes], anchors: np.ndarray, offsets: np.ndarray, windows: np.ndarray, sure: np.ndarray) -> list[np.ndarray]:
    """For each hull the windows (first, number; flat) that another hull of its anchor has too.

    ``sure``: hulls that occur more than once; they are only compared with."""
    data = np.frombuffer(b"".join(hulls), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(x) for x in hulls])[:-1]])
    owner = np.repeat(np.arange(len(hulls)), windows)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = base[owner] + step
    lead = offsets[owner] - step  # bytes from the window's start to the anchor: equal in equal windows
    order = np.lexsort((lead, anchors[owner]))
    starts, owner, step, lead = starts[order], owner[order], step[order], lead[order]
    kind = anchors[owner]
    change = np.concatenate([[True], (kind[1:] != kind[:-1]) | (lead[1:] != lead[:-1])])
    group = np.cumsum(change)
    size = np.bincount(group)[group]
    busy = size > 1
    starts, owner, step, group = starts[busy], owner[busy], step[busy], group[busy]
    hashes = Prefixes(data)
    order = merge_sort(data, hashes, starts, group)
    starts, owner, step = starts[order], owner[order], step[order]
    near = np.flatnonzero(group[1:] == group[:-1])
    same = near[common_prefix(hashes, starts[near], starts[near + 1]) >= LENGTH]
    # collision verification: the bytes themselves
    a, b = starts[same], starts[same + 1]
    agree, span = np.ones(len(same), bool), np.arange(LENGTH)
    for k in range(0, len(same), 512):
        agree[k : k + 512] = (data[a[k : k + 512, None] + span] == data[b[k : k + 512, None] + span]).all(axis=1)
    same = same[agree]
    hit = np.zeros(len(starts), bool)
    hit[same] = hit[same + 1] = True
    hit &= ~sure[owner]
    flags = np.zeros(int(windows.sum()), bool)
    flags[(np.cumsum(windows) - windows)[owner[hit]] + step[hit]] = True
    return [spans(flags[e - n : e]) for n, e in zip(windows.tolist(), np.cumsum(windows).tolist(), strict=True)]


def spans(flags: np.ndarray) -> np.ndarray:
    """(first, number) of each stretch of true, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    edge[1::2] -= edge[::2]
    return edge


MARKS = "doc binary, spans array<bigint>"


def marks_of(docs: list[bytes], found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.binary()), lists(found, pa.int64())], ["doc", "spans"])


def sort_groups(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their groups -> MARKS; whole groups, about CHUNK bytes at a time."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        groups, docs, places, datas, offsets, counts = (list(x) for x in zip(*rows, strict=True))
        numbers = np.cumsum([k > 0 and groups[k] != groups[k - 1] for k in range(len(groups))])
        windows = np.array([len(x) - LENGTH + 1 for x in datas])
        got = repeats(datas, numbers, np.array(offsets), windows, np.array(counts) > 1)
        keep = [k for k, x in enumerate(got) if len(x)]
        for k in keep:
            got[k][::2] += places[k]
        return marks_of([docs[k] for k in keep], [got[k] for k in keep])

    held, size, last = [], 0, None
    for part in parts:
        for row in zip(*(part.column(c).to_pylist() for c in ("group", "doc", "at", "data", "offset", "n")), strict=True):
            if size > CHUNK and row[0] != last:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
            last = row[0]
    if held:
        yield flush(held)


ITEMS = "group binary, doc binary, at bigint, offset int, n bigint, data binary"


def split_hulls(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hulls -> stretches (ITEMS): the windows whose offsets from the anchor lie in one range, dealt by
    the core that those windows share."""
    for part in parts:
        out: list[tuple] = []
        for doc, at, offset, n, data in zip(*(part.column(c).to_pylist() for c in ("doc", "at", "offset", "n", "data")), strict=True):
            windows = len(data) - LENGTH + 1
            step = 0
            while step < windows:
                number = (offset - step) // SPLIT
                end = min(windows, offset - number * SPLIT + 1)  # the step after the last one of this range
                anchor = offset - step  # in the stretch
                core = offset - number * SPLIT  # where the range's last window begins
                key = xxhash.xxh3_128_digest(data[core : core + LENGTH - SPLIT + 1], seed=number)
                out.append((key, doc, at + step, anchor, n, data[step : end + LENGTH - 1]))
                step = end
        columns = [list(x) for x in zip(*out, strict=True)] if out else [[]] * 6
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["group", "doc", "at", "offset", "n", "data"])


def crowded(hulls: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Marks of groups of more than GROUP hulls, and the stored tables they read."""
    items = store(hulls.mapInArrow(split_hulls, ITEMS), "items")
    kinds = items.groupBy("group", "offset", "data").agg(F.sum("n").alias("n"), F.min("doc").alias("doc"), F.min("at").alias("at"))
    kinds = store(kinds, "stretches")
    sizes = kinds.groupBy("group").agg(F.count("*").alias("kinds")).where("kinds > 1")
    pair = lambda count: F.array(F.col("at"), F.lit(count).cast("bigint") if isinstance(count, int) else count.cast("bigint")).alias("spans")
    whole = items.where("n = 1").join(kinds.where("n > 1").select("group", "offset", "data"), ["group", "offset", "data"])
    out = whole.select("doc", pair(F.length("data") - (LENGTH - 1)))
    dealt = kinds.join(sizes, "group")
    # a stretch that occurs once has one document and place; others are only compared with
    out = out.unionByName(dealt.where(F.col("kinds") <= GROUP).drop("kinds").repartition("group").sortWithinPartitions("group").mapInArrow(sort_groups, MARKS))
    each = F.explode(F.sequence(F.lit(0), F.length("data") - LENGTH))
    windows = dealt.where(F.col("kinds") > GROUP).select("doc", "at", "n", "data", each.alias("k"))
    windows = store(windows.select("doc", (F.col("at") + F.col("k")).alias("at"), "n", F.expr(f"substring(data, k + 1, {LENGTH})").alias("data")), "windows")
    twice = windows.groupBy("data").agg(F.sum("n").alias("times")).where("times > 1").select("data")
    out = out.unionByName(windows.where("n = 1").join(twice, "data", "left_semi").select("doc", pair(1)))
    return out, [items, kinds, windows]


def agreeing(data: np.ndarray, at: int, other: bytes) -> np.ndarray:
    """(place, windows; flat) of the strings of LENGTH bytes in which ``data`` from ``at`` on agrees with
    ``other``."""
    claimed = data[at : at + len(other)]
    if claimed.tobytes() == other:
        return np.array([at, len(other) - LENGTH + 1])
    edge = spans(claimed == np.frombuffer(other[: len(claimed)], np.uint8)).reshape(-1, 2)
    edge = edge[edge[:, 1] >= LENGTH]
    return (edge + [at, 1 - LENGTH]).ravel()


def cut_out(data: bytes, found: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left, and the maximal removed runs; ``found``: (place, windows) pairs, flat."""
    marks = np.zeros(len(data) + 1, np.int32)
    pairs = np.asarray(found, np.int64).reshape(-1, 2)
    np.add.at(marks, pairs[:, 0], 1)
    np.add.at(marks, pairs[:, 0] + pairs[:, 1] + LENGTH - 1, -1)
    gone = np.cumsum(marks[:-1]) > 0
    edge = spans(gone).reshape(-1, 2)
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), [(int(a), int(a + n)) for a, n in edge]


def claims(near: DataFrame, hulls: DataFrame) -> DataFrame:
    """(doc, at, size, source, place): stretches of documents that should equal one of ``source``.

    Within a document each occurrence of a hull vouches for the next one; the first occurrence of all
    vouches for the first of each other document, the last one for the first. Runs that adjoin in both
    places make one claim, so a copy, or a text that repeats itself, is one claim.
    """
    twice = hulls.where("n > 1").select("anchor", "hull", F.struct("one.doc", "one.at").alias("one"), "other")
    here = F.struct("doc", "at")
    pairs = near.join(twice, ["anchor", "hull"]).select("doc", "at", "windows", "hull", F.when(here == F.col("one"), F.col("other")).otherwise(F.col("one")).alias("rep"))
    pairs = pairs.dropDuplicates(["doc", "at"]).repartition("doc")  # rows that repeat id and text
    last = F.lag("at").over(Window.partitionBy("doc", "hull").orderBy("at"))
    pairs = pairs.withColumn("rep", F.when(last.isNotNull(), F.struct("doc", last.alias("at"))).otherwise(F.col("rep")))
    order = Window.partitionBy("doc").orderBy("at")
    before = lambda c: F.lag(c).over(order)
    joins = (F.col("rep.doc") == before("rep.doc")) & (F.col("rep.at") - F.col("at") == before(F.col("rep.at") - F.col("at"))) & (F.col("at") == before(F.col("at") + F.col("windows")))
    numbered = pairs.withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("claim", F.sum("new").over(order))
    merged = numbered.groupBy("doc", "claim").agg(F.min("at").alias("at"), F.sum("windows").alias("windows"), F.first("rep.doc").alias("source"), F.min("rep.at").alias("place"))
    return merged.select("doc", "at", (F.col("windows") + LENGTH - 1).alias("size"), "source", "place")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, kept, removed): the UTF-8 bytes left of each text, and the removed runs.

    A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else, in another
    document or in the same one, overlapping itself or not; all judged on the input.
    Null and empty texts, and texts under LENGTH bytes, lose nothing. Rows that repeat an id and text
    are documents of their own and so repeat each other. Ids may be null. Other columns are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.withColumn("doc", document_key(F.col("id"), F.col("text")))
    found = store(scan(rows), "runs")
    # what joins meet is stored first: adaptive execution can split a hot key only between plain shuffles
    met = store(found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    near = store(found.join(met, "anchor"), "near")
    drop(found, met)
    hulls = near.groupBy("anchor", "hull").agg(F.count("*").alias("n"), F.min(F.struct("doc", "at", "windows", "offset")).alias("one"), F.max(F.struct("doc", "at")).alias("other"))
    hulls = store(hulls, "hulls")

    # the texts, those that share an anchor with another apart
    at = new_path(spark, "texts")
    met = near.select("doc").distinct().withColumn("met", F.lit(1))
    rows.join(met, "doc", "left").withColumn("met", F.coalesce("met", F.lit(0))).write.option("compression", "zstd").partitionBy("met").parquet(at)
    texts = spark.read.schema(rows.select("id", "text", "doc").schema.add("met", "integer")).parquet(at)
    ours = texts.where("met = 1").drop("met")

    kinds = hulls.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    partial = hulls.join(kinds, "anchor").select("one.doc", "one.at", (F.col("one.windows") + LENGTH - 1).cast("bigint").alias("size"), F.col("one.doc").alias("source"), F.col("one.at").alias("place"), "anchor", "n", "kinds", "one.offset")
    wanted = partial.withColumn("whole", F.lit(0)).unionByName(claims(near, hulls).withColumn("whole", F.lit(1)), allowMissingColumns=True)
    sources = store(ours.dropDuplicates(["doc"]).select(F.col("doc").alias("source"), "text"), "sources")
    piece = F.expr("substring(text, cast(place as int) + 1, cast(size as int))").alias("data")
    to = new_path(spark, "fetched")
    fetched = wanted.join(sources, "source").select("whole", "doc", "at", "anchor", "n", "kinds", "offset", piece)
    fetched.write.option("compression", "zstd").partitionBy("whole").parquet(to)
    fetched = spark.read.schema(fetched.drop("whole").schema.add("whole", "integer")).parquet(to)
    drop(near, hulls, sources)

    hulls = fetched.where("whole = 0").drop("whole")
    small = hulls.where(F.col("kinds") <= GROUP).withColumnRenamed("anchor", "group").drop("kinds")
    by_sort = small.repartition("group").sortWithinPartitions("group").mapInArrow(sort_groups, MARKS)
    large, stored = crowded(hulls.where(F.col("kinds") > GROUP).drop("kinds", "anchor"))
    marks = by_sort.unionByName(large).groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("found"))
    marks = store(marks, "marks")
    drop(*stored)
    said = fetched.where("whole = 1").groupBy("doc").agg(F.collect_list(F.struct("at", "data")).alias("claims"))

    ident = rows.schema["id"].dataType.simpleString()
    removed_type = "array<struct<start:bigint,end:bigint>>"

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, kept, removed = [], [], []
            for data, found, claims in zip(part.column("text").to_pylist(), part.column("found").to_pylist(), part.column("claims").to_pylist(), strict=True):
                raw = np.frombuffer(data, np.uint8)
                every = [np.array(found or [], np.int64), *(agreeing(raw, c["at"], c["data"]) for c in claims or [])]
                left, gone = cut_out(data, np.concatenate(every))
                sizes.append(len(data))
                kept.append(left)
                removed.append([{"start": a, "end": b} for a, b in gone])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(removed, kind)], [id_col, "n_bytes", "kept", "removed"])

    joined = ours.join(marks, "doc", "left").join(said, "doc", "left").select("id", "text", "found", "claims")
    changed = joined.mapInArrow(finish, f"{id_col} {ident}, n_bytes bigint, kept binary, removed {removed_type}")
    rest = texts.where("met = 0").select(F.col("id").alias(id_col), F.length("text").cast("bigint").alias("n_bytes"), F.col("text").alias("kept"), F.expr(f"cast(array() as {removed_type})").alias("removed"))
    return changed.unionByName(rest)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur twice."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.col("n_bytes") - F.length("kept")
    return out.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        # for readers of a flag or of what is left
        (gone > 0).alias("has_repeats"), F.length("kept").cast("long").alias("kept_bytes"),
    )


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_removed, n_spans, kept_sha256) by counting every window; for small inputs."""
    seen: dict[bytes, int] = {}
    for x in texts:
        for k in range(len(x) - length + 1):
            seen[x[k : k + length]] = seen.get(x[k : k + length], 0) + 1
    out = []
    for x in texts:
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = True
        left = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((int(gone.sum()), len(spans(gone)) // 2, hashlib.sha256(left).hexdigest()))
    return out
