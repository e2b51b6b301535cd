"""Work that larger tables need dealt out, or done once, on small ones."""

import pyarrow as pa

from lodestone.operators import graph as G
from lodestone.plans import extraction as E
from lodestone.sources import extract as X
from lodestone.sources.script import Script
from lodestone.streaming import debounce as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_narrow_keys_of_wide_files_are_dealt(spark, tmp_path):
    """One row group of keys becomes many tasks of files, each read once."""
    spark.range(40).selectExpr("id as p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    files = E.rich(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() > 1
    found = X.flows(files)
    assert "MapInArrow" not in plan(found)
    assert found.count() == 40 * 13


def test_lines_count_through_comments_and_strings():
    text = "/* a\n b */ function f(x) {\n  const s = `1\n2`; // c\n  return g(x);\n}\nclass C {}"
    script = Script(text)
    assert script.symbols == [("f", "function", False, 2, 6), ("C", "class", False, 7, 7)]
    assert script.flow == [("f", "f", "PRODUCES"), ("g", "f", "DATA_FLOWS_TO"), ("f", "g", "CONSUMES")]


def test_edges_that_no_seed_leads_to_are_left_out(spark, monkeypatch):
    """Components are sought among what the seeds lead to: many copies of a graph beside it cost no round."""
    edges = [(a + 10 * c, b + 10 * c) for c in range(50) for a, b in ((0, 1), (1, 0), (1, 2), (1, 3), (3, 4), (5, 0))]
    sought = []
    found = G.strong_components
    monkeypatch.setattr(G, "strong_components", lambda e: sought.append(e.count()) or found(e))
    seeds = spark.createDataFrame([(1, 0, 1), (3, 1, 2), (999, 0, 4)], "node long, block int, mask long")
    got = {(r["node"], r["block"]): r["mask"] for r in G.spread(spark.createDataFrame(edges, "source long, target long"), seeds).collect()}
    assert got == {(0, 0): 1, (1, 0): 1, (2, 0): 1, (3, 0): 1, (4, 0): 1, (3, 1): 2, (4, 1): 2, (999, 0): 4}
    assert sought == [5]
    monkeypatch.setattr(G, "LOCAL_EDGES", 2)  # more edges are left than one task takes
    again = {(r["node"], r["block"]): r["mask"] for r in G.spread(spark.createDataFrame(edges, "source long, target long"), seeds).collect()}
    assert again == got


def test_changes_are_packed_by_key():
    """A key's state goes with every 10,000 rows of its: a batch is one row for each key, and none is lost."""
    n = 1000
    at = [pa.scalar(k * 10**6, pa.int64()).as_py() for k in range(n)]
    keys = [None if k % 10 == 0 else f"k{k % 3}" for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(at, pa.timestamp("us", "UTC")), pa.array(at), pa.array(range(n)), pa.array([f"p{k}" if k % 7 else None for k in range(n)])], ["key", "ts", "micros", "seq", "path"])
    rows = [r for out in D.pack(iter([batch])) for r in out.to_pylist()]
    assert sorted(str(r["key"]) for r in rows) == ["None", "k0", "k1", "k2"]
    d = D.Debounce(60, 5, None)
    d.add([r["packed"] for r in rows])
    assert sorted(d.waiting) == [(at[k], k, f"p{k}" if k % 7 else None) for k in range(n)]
    d.until(at[499])
    d = D.Debounce(60, 5, d.held())
    d.add([r["packed"] for r in rows])  # what has been taken is not taken again
    assert min(t for t, _, _ in d.waiting) == at[500]
