import random

import numpy as np
import pytest

from lodestone.llm import suffix_dedup as S


def text_of(rng, n):
    return "".join(rng.choice("abcdefg é\n") for _ in range(n))


def collection(seed, docs=60):
    """Texts that share passages at all sorts of edges, with copies and self-overlaps."""
    rng = random.Random(seed)
    shared = [text_of(rng, n) for n in (380, 399, 400, 401, 450, 700, 1500)]
    out = []
    for _ in range(docs):
        parts = [text_of(rng, rng.randint(0, 600))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 60)
            parts += [p[a:] if rng.random() < 0.4 else p, text_of(rng, rng.randint(0, 300))]
        out.append("".join(parts))
    out += [out[0], out[0], "ab" * 500, "x" * 399, "x" * 400, "x" * 900, "", "short"]
    return out


def compare(spark, texts):
    want = S.brute_force([t.encode() for t in texts])
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: r for r in S.remove_repeats(docs).collect()}
    import hashlib

    for k, (gone, runs, digest) in enumerate(want):
        r = got[k]
        assert (r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) == (gone, runs, digest), k


@pytest.mark.parametrize(("group", "split"), [(128, 16), (3, 16), (1, 7), (2, 1)])
def test_as_brute_force(spark, monkeypatch, group, split):
    """All ways: sorted groups, groups too large to sort that are dealt by more content, single windows."""
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "SPLIT", split)
    compare(spark, collection(group))


def test_whole_table_as_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    compare(spark, [r.text or "" for r in rows])


def test_very_long_and_repetitive_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 9000)
    rng = random.Random(8)
    long = text_of(rng, 30_000)
    compare(spark, ["line of text\n" * 3000, "x" * 20_000, long, text_of(rng, 500) + long[7000:25_000], "q" * 400])


def test_claims_that_do_not_hold():
    data = np.frombuffer(b"a" * 1000, np.uint8)
    assert S.agreeing(data, 100, b"a" * 500).tolist() == [100, 101]
    assert S.agreeing(data, 100, b"a" * 450 + b"b" + b"a" * 449).tolist() == [100, 51, 551, 50]
    assert S.agreeing(data, 100, b"a" * 300 + b"b" + b"a" * 300).tolist() == []


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(k, "w" * 500, 1, b"x", 3) for k in range(2)], "doc_id long, text string, n_bytes int, doc binary, met int")
    assert [(r.n_bytes, len(r.kept)) for r in S.remove_repeats(docs).collect()] == [(500, 0), (500, 0)]


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 700)
    rng = random.Random(5)
    data = text_of(rng, 4000).encode()
    found = set()
    for first, offset, held in S.pieces([b"", data, b"tail" * 150]):
        joined = b"".join(held)
        text, at, windows, _, _ = S.runs(np.frombuffer(joined, np.uint8), np.cumsum([len(x) for x in held]))
        base = np.concatenate([[0], np.cumsum([len(x) for x in held])[:-1]])
        for t, a, w in zip(text, at, windows, strict=True):
            for k in range(w):
                key = (first + t, a - base[t] + offset + k)
                assert key not in found
                found.add(key)
    assert found == {(1, k) for k in range(len(data) - S.LENGTH + 1)} | {(2, k) for k in range(600 - S.LENGTH + 1)}


def test_merge_sort_orders_suffixes():
    rng = random.Random(2)
    data = np.frombuffer(("".join(rng.choice("ab") for _ in range(3000)) + "a" * 900).encode(), np.uint8)
    starts = np.array([rng.randrange(0, 3400) for _ in range(300)])
    group = np.sort(np.array([rng.randrange(0, 5) for _ in range(300)]))
    order = S.merge_sort(data, S.Prefixes(data), starts, group)
    keys = [(group[k], data[starts[k] : starts[k] + S.LENGTH].tobytes()) for k in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(300))


def test_common_prefix():
    data = np.frombuffer(b"abcabcabd" + b"z" * 500, np.uint8)
    h = S.Prefixes(data)
    assert S.common_prefix(h, np.array([0, 0, 9]), np.array([3, 0, 10])).tolist() == [5, 400, 400]


def test_edges(spark):
    twin = "y" * 450
    rows = [(None, twin), (None, None), (7, twin), (7, twin), (8, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in S.remove_repeats(docs).collect())
    assert got == [(0, 0, 0), (0, 450, 0), (7, 450, 0), (7, 450, 0), (8, 0, 0), (9, 0, 0)]
    assert S.remove_repeats(docs.where("false")).count() == 0
