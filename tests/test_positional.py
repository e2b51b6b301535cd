"""The positional index against a search through the texts."""

import random
import re

from pyspark.sql import functions as F

from lodestone.operators.positional import PositionalIndex


def test_as_search_through_texts(spark):
    rng = random.Random(6)
    words = ["run", "run2", "$run", "_run", "héron", "Run", "x", "数字", "run-fast", "run.", "(run)"]
    docs = {k: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 12))) for k in range(40)}
    docs |= {90: "", 91: "\n\nrun\n", 92: None}
    symbols = [("run", 3), ("$run", None), ("héron", 91), ("数字", 5), ("nowhere", 1), ("x", 0)]
    index = PositionalIndex.build(spark.createDataFrame(list(docs.items()), "id long, text string"), "id", F.col("text"))
    frame = spark.createDataFrame(symbols, "symbol string, defined long")
    want, seen = {}, set()
    for symbol, defined in symbols:
        for doc, text in docs.items():
            lines = (text or "").split("\n")
            hit = [k for k, line in enumerate(lines) if symbol in re.findall(r"[\w$]+", line)]
            if hit and doc != defined:
                seen.add(symbol)
                near = sorted({j for k in hit for j in range(k - 2, k + 3) if 0 <= j < len(lines)})
                want[symbol, doc] = (len(hit), hit[0] + 1, "\n".join(lines[j] for j in near))
    got = {(r["symbol"], r["doc"]): (r["matches"], r["first_line"], r["context"]) for r in index.grep(frame).collect()}
    assert got == want
    assert {r["symbol"] for r in index.unseen(frame).collect()} == {s for s, _ in symbols} - seen == {"nowhere"}
    best = {}
    for (s, d), (n, _, text) in sorted(want.items(), key=lambda x: (x[0][0], -x[1][0], x[0][1])):
        best.setdefault(s, []).append((d, n, text))
    found = index.call_sites(frame, 3).orderBy("symbol", "rank").collect()
    assert [(r["symbol"], r["rank"], r["doc"], r["matches"], r["context"]) for r in found] == [(s, k, *x) for s in sorted(best) for k, x in enumerate(best[s][:3], 1)]
    places = index.postings.where("doc = 91").collect()
    assert [tuple(r) for r in places] == [("run", 91, 3, 1)]
    bits = {"run": (0, 1), "Run": (0, 2), "fast": (1, 1), "x": (1, 1 << 61), "unheard": (2, 1)}
    around: dict = {}
    for (symbol, _), (_, _, text) in want.items():
        for word in set(re.findall(r"[\w$]+", text)) & set(bits):
            block, bit = bits[word]
            key = dict(symbols)[symbol], block
            around[key] = around.get(key, 0) | bit
    near = index.near(frame, spark.createDataFrame([(w, *b) for w, b in bits.items()], "word string, block int, bit long"))
    assert {(r["defined"], r["block"]): r["mask"] for r in near.collect()} == around
