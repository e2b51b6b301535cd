"""Debounced changes: timers against a fold, late deliveries, failing batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.store import Table
from lodestone.shared import new_folder
from lodestone.streaming.debounce import Debounce, debounced, deliver

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key string, path string, ts timestamp, seq long"


def fold(rows, quiet, most):
    """(reason, paths) of each batch of one key."""
    out, pending, last = [], set(), None
    for ts, _, path in sorted(rows):
        if pending and ts - last >= quiet:
            out.append((last + quiet, "quiet", len(pending)))
            pending = set()
        pending.add(path)
        last = ts
        if len(pending) >= most:
            out.append((ts, "full", len(pending)))
            pending = set()
    return out + ([(last + quiet, "quiet", len(pending))] if pending else [])


def run(spark, files, folder, act=lambda b: b, **kw):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    done, failed = (Table(spark, new_folder(spark, name)) for name in ("done", "failed"))
    q = deliver(debounced(stream, **kw), done, failed, act, "d").option("checkpointLocation", new_folder(spark, "state")).start()
    q.awaitTermination()
    return done, failed


def test_timers_as_fold(spark):
    rng = random.Random(1)
    events, at = [], 0
    for k in range(160):
        at += rng.choice([1, 2, 5, 30, 61])
        events.append((rng.choice("ab"), f"p{rng.randrange(9)}", T0 + dt.timedelta(minutes=at), k))
    files = [events[k : k + 20] for k in range(0, 160, 20)]
    for f in files:
        rng.shuffle(f)
    files[2], files[3] = files[3], files[2]  # out of order, within the delay
    tick = [(key, None, T0 + dt.timedelta(days=30), 0) for key in "ab"]
    done, _ = run(spark, [*files, tick], new_folder(spark, "feed"), quiet="45 minutes", delay="3 days", most=5)
    got = {}
    for r in done.read().orderBy("key", "number").collect():
        got.setdefault(r["key"], []).append((r["ended"], r["reason"], r["paths"]))
    assert got == {key: fold([(t, s, p) for k, p, t, s in events if k == key], dt.timedelta(minutes=45), 5) for key in "ab"}
    assert {reason for rows in got.values() for _, reason, _ in rows} == {"quiet", "full"}


def test_a_timer_fires_without_changes(spark):
    """Another key's changes move the watermark; the quiet key's batch comes by its timer."""
    files = [[("a", "x", T0, 1)], [("b", "y", T0 + dt.timedelta(hours=5), 2)], [("b", "z", T0 + dt.timedelta(hours=6), 3)]]
    done, _ = run(spark, files, new_folder(spark, "feed"), quiet="10 minutes", delay="1 minute")
    got = {(r["key"], r["paths"], r["ended"]) for r in done.read().collect()}
    assert ("a", 1, T0 + dt.timedelta(minutes=10)) in got and len(got) == 2


def test_a_bad_batch_does_not_poison_later_ones(spark):
    files = [[("a", f"p{k}", T0 + dt.timedelta(hours=k), k)] for k in range(5)] + [[("a", None, T0 + dt.timedelta(days=9), 9)]]
    bad = []

    def act(batch):
        rows = batch.select("number").collect()
        if rows and not bad:
            bad.extend(r["number"] for r in rows)
            raise ValueError("bad batch")
        return batch

    done, failed = run(spark, files, new_folder(spark, "feed"), act, quiet="10 minutes", delay="1 minute")
    assert {r["number"] for r in done.read().collect()} == set(range(5)) - set(bad)
    assert [(r["number"], r["error"]) for r in failed.read().collect()] == [(n, "ValueError: bad batch") for n in bad] and bad


def test_state_goes_on():
    """Cut anywhere and carried on, the state gives the same batches."""
    rng = random.Random(3)
    rows = [(rng.randrange(4000), k, f"p{rng.randrange(6)}") for k in range(300)]
    want = Debounce(40, 4, None)
    want.waiting = list(rows)
    want.until(10_000)
    held, out, before = None, [], -1
    for now in (*range(0, 4000, 97), 10_000):
        d = Debounce(40, 4, held)
        d.waiting += [r for r in rows if before < r[0] <= now]
        before = now
        d.until(now)
        held, out = d.held(), out + d.out
    assert out == want.out and d.due() is None
