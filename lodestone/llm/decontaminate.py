"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is split into e + 1 pieces; whatever lies within the budget
holds one piece unchanged. All pieces are searched at once with an Aho-Corasick automaton; around each
hit Myers' bit-parallel algorithm computes the least edit distance of the item to a passage.

Most hits are chance. They are told by a tree over the pieces: a run of n pieces is allowed n - 1 edits,
and if a run keeps to that, one of its halves does too. So a passage within the budget has a piece from
which every run up to the whole item keeps to its allowance; a hit without that is not verified further.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, drop, store

#: Edits allowed for a character of an item. A passage is lost only if its normalised text differs by more.
ERROR_RATE = 0.10
#: Characters of items that are on the driver and broadcast at once; more items are taken in blocks of
#: about this size, one after the other.
BLOCK_CHARS = 4_000_000


@lru_cache(1)
def _plain() -> np.ndarray:
    """For each code point its lower case (one code point), or a space if no letter or digit."""
    return np.fromiter((ord(ch.lower()[0]) if (ch := chr(k)).isalnum() else 32 for k in range(0x110000)), np.uint32, 0x110000)


def normalise(text: str) -> str:
    """Lower case; every run of anything but letters and digits is one space."""
    got = _plain()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = got == 32
    again = gap[1:] & gap[:-1]
    if again.any():
        got = got[np.concatenate([[True], ~again])]
    return got.tobytes().decode("utf-32-le", "surrogatepass").strip(" ")


def myers(masks: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int]:
    """Least edit distance of a pattern to a substring of ``text``, and where that one ends (first
    such end; -1 if above the budget). ``masks``: for each character the bits of its places."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, budget + 1, -1
    get = masks.get
    for k, ch in enumerate(text):
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, k + 1
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for at, ch in enumerate(pattern):
        masks[ch] = masks.get(ch, 0) | 1 << at
    return masks


def within(masks: dict[str, int], m: int, text: str, budget: int) -> bool:
    """Whether a substring of ``text`` is within ``budget`` edits of the pattern."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    pv, mv, score = full, 0, m
    get = masks.get
    for ch in text:
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score <= budget:
                return True
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return False


@lru_cache(256)
def runs_above(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces the runs (first, end) that hold it, smallest first, the whole left out."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
            if b - a < n:
                for k in range(a, b):
                    out[k].insert(0, (a, b))
    return out


#: Masks that are kept for reuse; they are made when a hit asks for them.
MASKS = 20_000


class Items:
    """Searchable benchmark items: (key, text) pairs. Every item is searched together with the spaces
    around it, so that one without an edit to spare matches whole words only.

    An item takes its text, and its pieces a number each in the automaton; all else is made on a hit."""

    def __init__(self, items: tuple[tuple[str, str], ...], rate: float):
        self.rows: list[tuple[str, str, int]] = []
        self.automaton = ahocorasick.Automaton()
        shared: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            plain = normalise(text or "")
            if not plain:
                continue
            k, budget = len(self.rows), math.floor(rate * len(plain))
            self.rows.append((item, f" {plain} ", budget))
            for i in range(budget + 1):
                a, b = self.bound(k, i), self.bound(k, i + 1)
                piece = self.rows[k][1][a:b]
                if piece in shared:
                    shared[piece].append((k, i))
                elif piece in self.automaton:
                    shared[piece] = [self.automaton.get(piece), (k, i)]
                else:
                    self.automaton.add_word(piece, (k, i))
        for piece, where in shared.items():  # pieces of several places
            self.automaton.add_word(piece, where)
        self.any = bool(self.rows)
        if self.any:
            self.automaton.make_automaton()
        self.kept: dict[tuple[int, int, int], dict[str, int]] = {}

    def bound(self, k: int, i: int) -> int:
        """Where piece i of item k begins."""
        _, plain, budget = self.rows[k]
        return len(plain) * i // (budget + 1)

    def masks(self, k: int, a: int, b: int) -> dict[str, int]:
        """The masks of a stretch of an item."""
        got = self.kept.get((k, a, b))
        if got is None:
            if len(self.kept) >= MASKS:
                self.kept.clear()
            got = self.kept[k, a, b] = masks_of(self.rows[k][1][a:b])
        return got

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(item's key, distance, end in the normalised text), the best passage of each item found."""
        plain = normalise(text)
        out = []
        if not self.any or not plain:
            return out
        whole, plain = len(plain), f" {plain} "
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, where in self.automaton.iter(plain):
            for k, i in [where] if isinstance(where, tuple) else where:
                _, item, budget = self.rows[k]
                a = self.bound(k, i)
                begin = last + 1 - (self.bound(k, i + 1) - a)
                for x, y in runs_above(budget + 1)[i]:
                    at, edits = self.bound(k, x), y - x - 1
                    length = self.bound(k, y) - at
                    lo = begin - a + at - edits
                    if not within(self.masks(k, at, at + length), length, plain[max(lo, 0) : lo + length + 2 * edits], edits):
                        break
                else:
                    spans.setdefault(k, []).append((begin - a - budget, begin - a + len(item) + budget))
        for k, windows in spans.items():
            item, pattern, budget = self.rows[k]
            masks = self.masks(k, 0, len(pattern))
            windows.sort()
            best, end = budget + 1, -1
            lo, hi = windows[0]
            for a, b in [*windows[1:], (math.inf, math.inf)]:
                if a <= hi:  # overlapping windows are searched once
                    hi = max(hi, b)
                    continue
                lo = max(lo, 0)
                got, where = myers(masks, len(pattern), plain[lo:hi], budget)
                if got < best:
                    best, end = got, lo + where
                if not best:
                    break
                lo, hi = a, b
            if end >= 0:
                end -= 1 + (plain[end - 1] == " ")  # the space before the text, and after the item
                out.append((item, best, min(max(end, 0), whole)))
        return out


@lru_cache(4)
def _items(items: tuple[tuple[str, str], ...], rate: float) -> Items:
    return Items(items, rate)


def item_key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def item_blocks(items: DataFrame, text_col: str) -> Iterator[tuple[tuple[tuple[str, str], ...], bool]]:
    """(key, text) of the different texts of items, about BLOCK_CHARS characters at a time, and whether
    a block is the only one. One block is on the driver at a time."""
    rows = items.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct().withColumn("key", item_key(F.col("text")))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(total // BLOCK_CHARS) + 1
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("key"), F.lit(n)) == k)
        yield tuple(sorted((r.key, r.text) for r in block.collect())), n == 1


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """(id_col, item_col, distance, end): the items found in each document, best passage each.

    ``distance`` counts edits between normalised texts, at most floor(rate * item's length); ``end`` is
    where the passage ends in the normalised document. Whole texts are searched. The spaces around an
    item count as characters of it, so an item without an edit to spare matches whole words.
    Null and empty texts, and items without a letter or digit, match nothing. Repeated documents and
    repeated items match each for itself; an item's text is searched once. Null ids are carried through;
    other columns are not read. Empty tables give an empty result. Items of more than BLOCK_CHARS
    characters are searched block by block, each block's matches being written.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, key string, distance int, `end` bigint"
    batches(spark)
    out = None
    for block, alone in item_blocks(items, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = _items(shared.value, rate)
            for part in parts:
                hits = [(row, *hit) for row, text in enumerate(part.column("text").to_pylist()) for hit in search.find(text)]
                if hits:
                    row, key, distance, end = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(row)), pa.array(key, pa.string()), pa.array(distance, pa.int32()), pa.array(end, pa.int64())], ["id", "key", "distance", "end"])

        found = rows.mapInArrow(run, schema)
        if not alone:
            found = store(found, "matches")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    named = items.where(F.col(item_text).isNotNull()).select(item_key(F.col(item_text)).alias("key"), F.col(item_col).alias("item"))
    return out.join(named, "key").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "distance", "end")


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The documents in which no item is found (as in ``matches``), with all their columns. Null texts stay."""
    spark = docs.sparkSession
    batches(spark)
    for block, alone in item_blocks(items, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = _items(shared.value, rate)
            for part in parts:
                keep = [text is None or not search.find(text) for text in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

        before, docs = docs, docs.mapInArrow(run, docs.schema)
        if not alone:
            docs = store(docs, "clean")
            shared.destroy()
            if hasattr(before, "_stored_at"):
                drop(before)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
