from collections import defaultdict

import pytest

from lodestone.llm import minhash
from lodestone.llm.minhash import near_duplicates


def brute(rows, words, percent=80):
    sets = []
    for _, text in rows:
        found = (text or "").encode().lower().split()
        if not found:
            sets.append(frozenset())
        elif len(found) < words:
            sets.append(frozenset([tuple(found)]))
        else:
            sets.append(frozenset(tuple(found[k : k + words]) for k in range(len(found) - words + 1)))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (ident, _) in enumerate(rows):
        if ident is not None:
            least[root(i)].append(ident)
    return sorted((ident, len(sets[i]), min(least[root(i)], default=None)) for i, (ident, _) in enumerate(rows) if ident is not None)


@pytest.mark.parametrize("words", [2, 5])
def test_as_brute_force(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], words)
    got = near_duplicates(docs, words=words).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chains_of_near_copies(spark, monkeypatch):
    """A drifting chain: far ends are linked only through others, and leaders miss many links."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"w{k}" for k in range(60)]
    rows = [(100 - k, " ".join(base[:k] + [f"x{j}" for j in range(k, 60)])) for k in range(0, 60, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs, words=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 2)


def test_edges(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \t\n", 9), (4, "one", 9), (5, "ONE", 9), (None, "one", 9), (6, "a b c", 1), (6, "a b c", 1), (None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, words=2).collect()), key=str)
    assert got == sorted([(0, 0, None, True), (0, 1, 4, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True), (6, 2, 6, True)], key=str)
    assert near_duplicates(docs.where("false"), words=2).count() == 0
