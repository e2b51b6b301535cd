"""Language identification by cross-parsing entropy.

From a bounded sample of labelled text a suffix automaton is made per language. A text is parsed with
each automaton into longest matches with that language's sample; the language that needs the fewest
phrases, normalised by what its own held-out text needs, wins.

Automata read UTF-8 bytes, so scripts of any size and any mixture of them are told apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, drop, store

#: The fit's bounds, whatever the input's size: documents and bytes per language, bytes of the languages that
#: are compared in one pass, and how many these are. A suffix automaton has at most two states for a byte;
#: its table has a column for each different byte of the sample. More languages take more passes.
SAMPLE_DOCS, SAMPLE_BYTES, TOTAL_BYTES, PASS_LANGUAGES = 64, 24_000, 240_000, 200
#: More different values are no languages: they are an error, and none is left out in silence.
MAX_LANGUAGES = 20_000
#: Bytes that are parsed one after the other; all blocks of a batch are parsed at once.
BLOCK = 256
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
GAP = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Lower-cased letters in UTF-8; each run of anything else is one space."""
    return GAP.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


class Automaton:
    """A suffix automaton of ``data``: ``table`` has a row of transitions for each state, -1 where none;
    ``column`` the column of each byte, 0 for bytes that ``data`` lacks."""

    def __init__(self, data: bytes):
        used = sorted(set(data))
        self.width = len(used) + 1
        self.column = np.zeros(256, np.int32)
        self.column[used] = np.arange(1, self.width)
        step, link, length, last = [{}], [-1], [0], 0
        for c in data:
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        table = np.full((len(step), self.width), -1, np.int32)
        for state, edges in enumerate(step):
            for c, to in edges.items():
                table[state, self.column[c]] = to
        self.table = table.ravel()

    def advance(self, blocks: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each row of ``blocks`` (columns of bytes, padded), of which ``sizes`` are
        real and do not rise from row to row, and the states after them. A state other than 0 is an open
        phrase. A byte that the sample lacks is a phrase by itself."""
        state = state.copy()
        count = np.zeros(len(blocks), np.int32)
        ends = np.searchsorted(-sizes, -np.arange(blocks.shape[1]), side="left")
        for k in range(blocks.shape[1]):
            n = ends[k]
            if not n:
                break
            c = blocks[:n, k]
            now = state[:n]
            to = self.table.take(now * self.width + c)
            miss = to < 0
            count[:n] += miss & (now > 0)
            to = np.where(miss, self.table.take(c), to)
            lost = to < 0
            count[:n] += lost
            state[:n] = np.where(lost, 0, to)
        return count, state

    def phrases(self, blocks: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Phrases of the longest-match parse of each text. ``owner``: the text of each block, in order.

        All blocks are parsed at once from an empty phrase. A block whose predecessor ended inside one is
        parsed again from there, and so on until nothing changes: the parse of the whole text. Two parses
        of the same bytes soon agree on a state, so a second round is mostly the last.
        """
        order = np.argsort(-sizes, kind="stable")
        columns = self.column[blocks[order]]
        begin = np.zeros(len(blocks), np.int32)
        count, end = np.zeros(len(blocks), np.int32), np.zeros(len(blocks), np.int32)
        follows = np.concatenate([[False], owner[1:] == owner[:-1]]) if len(owner) else np.zeros(0, bool)
        todo = np.ones(len(blocks), bool)
        while todo.any():
            rows = order[todo[order]]
            count[rows], end[rows] = self.advance(columns[todo[order]], sizes[rows], begin[rows])
            carried = np.where(follows, np.concatenate([[0], end[:-1]]), 0)
            todo = carried != begin
            begin = carried.astype(np.int32)
        total = np.bincount(owner, count, int(owner[-1]) + 1 if len(owner) else 0)
        last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, bool)
        np.add.at(total, owner[last], end[last] > 0)
        return total.astype(np.int64)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of the texts, padded, their sizes, and the text of each; an empty text has an empty block."""
    counts = np.array([max(1, -(-len(x) // BLOCK)) for x in texts], np.int64)
    blocks = np.zeros((int(counts.sum()), BLOCK), np.uint8)
    sizes = np.full(len(blocks), BLOCK, np.int64)
    at = 0
    for x, n in zip(texts, counts.tolist(), strict=True):
        blocks[at : at + n].reshape(-1)[: len(x)] = np.frombuffer(x, np.uint8)
        at += n
        sizes[at - 1] = len(x) - (n - 1) * BLOCK
    return blocks, sizes, np.repeat(np.arange(len(texts)), counts)


class Model:
    """Automata and their norms. ``samples``: language -> text."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.known, self.automata, self.norms = [], [], []
        for name in self.languages:
            data = plain(samples[name])
            # every fifth stretch is held out to learn how many phrases the language itself needs
            size = max(1, min(BLOCK, len(data) // 5))
            stretches = [data[k : k + size] for k in range(0, len(data), size)]
            known = b"".join(x for k, x in enumerate(stretches) if k % 5 != 4)
            held = stretches[4::5] or [data]
            self.known.append(known)
            self.automata.append(Automaton(known))
            needs = np.maximum(self.automata[-1].phrases(*cut(held)), 1) / np.maximum([len(x) for x in held], 1)
            self.norms.append(float(np.median(needs)))  # a few stretches may repeat known ones

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text in each language."""
        blocks, sizes, owner = cut(texts)
        return np.stack([a.phrases(blocks, sizes, owner) for a in self.automata], axis=1)

    def rates(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language, over what a text of that language needs; 1 where a text has no
        letter."""
        lettered = _lettered(texts)
        rates = np.ones((len(texts), len(self.languages)))
        group, size = [], 0
        for k, ok in enumerate([*lettered, None]):  # about four million bytes of text at once
            if ok:
                group.append(k)
                size += len(texts[k])
            if group and (ok is None or size > 4_000_000):
                rates[group] = self.counts([plain(texts[g]) for g in group]) / np.array(self.norms)
                group, size = [], 0
        return rates


def _lettered(texts: list[str]) -> list[bool]:
    return [bool(t) and LETTER.search(t) is not None for t in texts]


@lru_cache(2)
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(dict(samples))


def held_out(id_col: str):
    """Documents that no fit may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, text) pairs from at most SAMPLE_DOCS documents a language that are not held out.

    Ids are dealt over SAMPLE_DOCS hash buckets; each language gives the document of the least hash in
    each bucket, a bounded aggregate with partial sums; only those documents' texts are then read.
    """
    can = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    hashed = can.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    picked = hashed.groupBy("lang", F.pmod("h", F.lit(SAMPLE_DOCS)).alias("bucket")).agg(F.min(F.struct("h", "id")).alias("least"))
    most = picked.groupBy("lang").agg(F.collect_list("least.id").alias("ids")).limit(MAX_LANGUAGES + 1)
    chosen = {r.lang: r.ids for r in most.collect()}  # SAMPLE_DOCS ids a language
    if not chosen:
        return ()
    if len(chosen) > MAX_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MAX_LANGUAGES} different values")
    each = min(SAMPLE_BYTES, TOTAL_BYTES // min(len(chosen), PASS_LANGUAGES))
    share = max(2 * each // SAMPLE_DOCS, 512)
    picks = [(k, x) for k, ids in chosen.items() for x in ids]
    wanted = docs.sparkSession.createDataFrame(picks, hashed.select("lang", "id").schema)
    wanted = F.broadcast(wanted) if len(picks) <= SAMPLE_DOCS * PASS_LANGUAGES else wanted
    rows = can.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.substring(text_col, 1, 64 * share).alias("text")).join(wanted, ["lang", "id"])
    rows = rows.groupBy("lang", "id").agg(F.min("text").alias("text"))  # of rows that repeat an id, the least text
    texts: dict[str, list[str]] = {}
    taken: dict[str, int] = {}
    found = sorted(rows.collect(), key=lambda r: (r.lang, str(r.id), r.text))
    for limit in (share, 64 * share):  # longer parts only where short documents leave room
        for r in found:
            part = r.text[:limit] if limit == share else r.text[share:limit]
            room = each - taken.get(r.lang, 0)
            part = part.encode("utf-8", "surrogatepass")[: max(room, 0)].decode("utf-8", "ignore")
            if part:
                texts.setdefault(r.lang, []).append(part)
                taken[r.lang] = taken.get(r.lang, 0) + len(part.encode())
    return tuple((k, "\n".join(v)) for k, v in sorted(texts.items()))


def identify(docs: DataFrame, learned: tuple[tuple[str, str], ...], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of those names are replaced.

    Whole texts are parsed; of languages that fit equally well the first by name is told. The score is how
    much fewer normalised phrases the winner needs than the next, from 0 (as many) towards 1; 1 where one
    language is known. Null texts and texts without a letter are ``und`` with score 0, and so is everything
    where nothing was learned. Repeated rows get equal answers; an empty table gives an empty result.

    PASS_LANGUAGES are compared at once. With more, each pass reads what the one before has written, and
    carries the best two rates.
    """
    spark = docs.sparkSession
    batches(spark)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")])
    state = kept.select("*", docs[text_col].alias("__text"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("inf")).alias("__one"), F.lit(float("inf")).alias("__two"))
    passes = [learned[k : k + PASS_LANGUAGES] for k in range(0, len(learned), PASS_LANGUAGES)]
    for k, some in enumerate(passes):

        last = k == len(passes) - 1
        schema = state.drop("__text").schema if last else state.schema  # texts don't come back from the last pass

        def run(parts: Iterator[pa.RecordBatch], some=some, last=last) -> Iterator[pa.RecordBatch]:
            model = _model(some)
            for part in parts:
                texts = part.column("__text").to_pylist()
                names, one, two = (part.column(c).to_pylist() if c == "lang_pred" else part.column(c).to_numpy().copy() for c in ("lang_pred", "__one", "__two"))
                if texts:
                    rates = model.rates(texts)
                    best = rates.argmin(axis=1)
                    least = rates[np.arange(len(texts)), best]
                    nearer = (least < one) & np.array(_lettered(texts))
                    names = [model.languages[b] if now else old for b, now, old in zip(best, nearer, names, strict=True)]
                    one, two = np.partition(np.column_stack([one, two, rates]), 1, axis=1)[:, :2].T
                own = [c for c in part.schema.names[:-3] if not last or c != "__text"]
                yield pa.RecordBatch.from_arrays([*map(part.column, own), pa.array(names, pa.string()), pa.array(one, pa.float64()), pa.array(two, pa.float64())], [*own, *part.schema.names[-3:]])

        before, state = state, state.mapInArrow(run, schema)
        if not last:
            state = store(state, "rates")
            if hasattr(before, "_stored_at"):
                drop(before)
    score = F.when(F.col("lang_pred") == UNKNOWN, 0.0).when(F.lit(len(learned) == 1), 1.0).otherwise(1 - F.col("__one") / F.greatest("__two", F.lit(1e-9)))
    return state.select(*[F.col(f"`{c}`") for c in kept.columns], "lang_pred", score.alias("score"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text").withColumn("held_out", held_out("doc_id")), samples(docs))
    return out.select("doc_id", "held_out", "lang_pred", "score")
