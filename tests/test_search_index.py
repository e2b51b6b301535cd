"""The segmented index against one that is built anew by hand."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators.search_index import SearchIndex
from lodestone.plans import retrieval as P
from lodestone.shared import new_folder

SCHEMA = "id long, text string"


def plain(docs, terms):
    found = {i: [t for t in re.split("[^a-z0-9]+", (x or "").lower()) if t] for i, x in docs.items()}
    n, length = len(found), sum(map(len, found.values())) / max(len(found), 1)
    out = {}
    for i, words in found.items():
        score = 0
        for t in terms:
            tf, df = words.count(t), sum(t in w for w in found.values())
            if tf:
                idf = math.log((n - df + 0.5) / (df + 0.5))
                score -= (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / length))
        if set(terms) & set(words):
            out[i] = score
    return out


def same(index, docs, terms):
    assert {r["doc"]: r["score"] for r in index.search(terms).collect()} == pytest.approx(plain(docs, terms), abs=1e-9)
    words = [t for x in docs.values() for t in set(re.split("[^a-z0-9]+", (x or "").lower())) if t]
    assert {r["term"]: r["df"] for r in index.frequencies().collect()} == Counter(words)
    assert {r["doc"] for r in index.documents().collect()} == set(docs)


def test_as_built_anew(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "rare"]) for _ in range(rng.randint(0, 9)))
    index, docs = SearchIndex(spark, new_folder(spark, "index")), {}
    same(index, docs, ["alpha"])
    for step in range(5):
        new = {rng.randrange(30): text() for _ in range(12)}
        new[99] = None
        index.upsert(spark.createDataFrame([*new.items(), (None, "alpha")], SCHEMA), "id", F.col("text"), batch=("s", step))
        index.upsert(spark.createDataFrame([(5, "never")], SCHEMA), "id", F.col("text"), batch=("s", step))  # applied before
        docs |= new
        if step % 2:
            gone = {rng.randrange(40) for _ in range(6)}
            index.delete(spark.createDataFrame([(g,) for g in gone], "key long"))
            docs = {i: x for i, x in docs.items() if i not in gone}
        if step == 3:
            index.compact()
        same(index, docs, ["alpha", "rare", "nowhere"])


def test_refresh_and_torn_write(spark, monkeypatch):
    index = SearchIndex(spark, new_folder(spark, "index"))
    docs = {k: f"word{k} common" for k in range(6)}
    frame = lambda d: spark.createDataFrame(list(d.items()), SCHEMA)
    assert index.refresh(frame(docs), "id", F.col("text")) == (6, 0)
    assert index.refresh(frame(docs), "id", F.col("text")) == (0, 0)
    new = {k: x for k, x in docs.items() if k != 2} | {1: "other common", 8: "new"}
    assert index.refresh(frame(new), "id", F.col("text")) == (2, 1)
    same(index, new, ["common", "other"])
    with monkeypatch.context() as m:  # dies before its commit
        m.setattr(index.commits, "append", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.upsert(frame({3: "lost", 50: "lost"}), "id", F.col("text"))
    same(index, new, ["common", "lost"])
    index.upsert(frame({3: "found"}), "id", F.col("text"))
    same(index, new | {3: "found"}, ["common", "found"])


def test_session_index_notices_changes(spark, tmp_path):
    def put(n):
        rows = [(k, f"heron text {k}", "en", "web", 5) for k in range(n)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")

    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    put(20)
    first = P.file_index(spark, str(tmp_path))
    assert first.search(["src"]).count() == first.statistics()[0] > 0
    known = first.statistics()[0]
    put(31)
    again = P.file_index(spark, str(tmp_path))
    assert again is first and again.search(["src"]).count() == again.statistics()[0] == again.documents().count() > known
    assert P.file_index(spark, str(tmp_path))._log() == again._log()
