"""Debounced changes: batches of paths per key, held in state until a quiet period ends or a batch is full.

Timers run on event time. Changes wait in the state until the watermark has passed them and are then taken in
order of (time, number), so the batches are those of a fold over all changes in that order, however micro-batches
cut them. Changes of a time that has been taken already are dropped, as streams do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import Table

OUT = "key string, number long, ended timestamp, reason string, paths long, digest string"
#: What waits is one value, an Arrow stream of (ts, seq, path): lists of it would be turned over item by item.
STATE = "number long, last long, pending array<string>, waiting binary, taken long"
#: The changes of a key in one batch of rows, packed likewise, and the latest time: a key's state goes to Python
#: with every 10,000 rows of its, so that rows should be few.
PACKED = "key string, ts timestamp, packed binary"
WAITING = pa.schema([("ts", pa.int64()), ("seq", pa.int64()), ("path", pa.string())])


def _packed(rows: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, WAITING, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(rows)
    return out.getvalue().to_pybytes()


def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, ts, micros, seq, path), a row for each key of a batch."""
    for part in parts:
        rows = pa.Table.from_batches([part])
        for key in pc.unique(rows["key"]):
            mine = rows.filter(pc.equal(rows["key"], key) if key.is_valid else pc.is_null(rows["key"]))
            told = pa.table([mine["micros"], mine["seq"], mine["path"]], names=WAITING.names).cast(WAITING)
            yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.string()), pa.array([pc.max(mine["ts"]).as_py()], rows["ts"].type), pa.array([_packed(told)], pa.binary())], ["key", "ts", "packed"])


class Debounce:
    """The state of one key: what is pending, when the last change came (microseconds), and what waits: an Arrow
    table (``later``), which is not turned into rows before their time."""

    def __init__(self, quiet: int, most: int, held: tuple | None):
        self.quiet, self.most = quiet, most
        self.number, self.last, pending, waiting, self.taken = held or (0, 0, [], b"", None)
        self.pending = dict.fromkeys(pending)
        self.later = WAITING.empty_table()
        if waiting:
            with pa.ipc.open_stream(bytes(waiting)) as stream:
                self.later = stream.read_all()
        self.out: list[tuple] = []

    def flush(self, at: int, reason: str) -> None:
        told = hashlib.sha256(",".join(sorted(self.pending, key=str.encode)).encode()).hexdigest()
        self.out.append((self.number, at, reason, len(self.pending), told))
        self.number += 1
        self.pending = {}

    @property
    def waiting(self) -> list[tuple]:
        """What waits as rows of (ts, seq, path)."""
        return list(zip(*[c.to_pylist() for c in self.later.columns]))

    @waiting.setter
    def waiting(self, rows: list[tuple]) -> None:
        self.later = pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(WAITING)], schema=WAITING)

    def add(self, packs: list[bytes]) -> None:
        """Take in what came, but for changes of a time that has been taken."""
        for pack in packs:
            with pa.ipc.open_stream(pack) as stream:
                came = stream.read_all()
            if self.taken is not None:
                came = came.filter(pc.greater(came["ts"], self.taken))
            self.later = pa.concat_tables([self.later, came])

    def until(self, now: int) -> None:
        """Take all that happened up to ``now``; a change without a path only tells the time."""
        self.taken = now
        past = pc.less_equal(self.later["ts"], now)
        taken = self.later.filter(past).sort_by([("ts", "ascending"), ("seq", "ascending")])
        self.later = self.later.filter(pc.invert(past))
        for ts, path in zip(taken["ts"].to_pylist(), taken["path"].to_pylist()):
            if self.pending:
                self.rest(ts)
            if path is not None:
                self.pending[path], self.last = None, ts
                if len(self.pending) >= self.most:
                    self.flush(ts, "full")
        self.rest(now)

    def rest(self, now: int) -> None:
        """The quiet period may have ended."""
        if self.pending and self.last + self.quiet <= now:
            self.flush(self.last + self.quiet, "quiet")

    def held(self) -> tuple:
        return self.number, self.last, list(self.pending), _packed(self.later) if self.later.num_rows else b"", self.taken

    def due(self) -> int | None:
        """When something may next happen, if nothing comes."""
        times = [pc.min(self.later["ts"]).as_py()] if self.later.num_rows else []
        return min([*times, self.last + self.quiet] if self.pending else times, default=None)


def debounced(stream: DataFrame, quiet: str, delay: str, most: int = 256) -> DataFrame:
    """(key, number, ended, reason, paths, digest): the batches of a stream of (key, path, ts, seq).

    A batch ends when no change came for ``quiet`` (at that time), or at once when it holds ``most`` different
    paths. ``delay`` is how late changes may come. ``digest`` is the sha256 of the sorted paths, comma-joined.
    """
    period = pd.Timedelta(quiet) // pd.Timedelta(microseconds=1)

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = Debounce(period, most, state.get if state.exists else None)
        for frame in frames:
            d.add([bytes(x) for x in frame["packed"]])
        now = state.getCurrentWatermarkMs()
        d.until(now * 1000)
        state.update(d.held())  # kept when nothing waits, too: batches are numbered on
        if (due := d.due()) is not None:
            state.setTimeoutTimestamp(max(due // 1000, now + 1))
        if d.out:
            number, ended, reason, paths, told = zip(*d.out)
            yield pd.DataFrame({"key": key[0], "number": number, "ended": pd.to_datetime(ended, unit="us"), "reason": reason, "paths": paths, "digest": told})

    rows = stream.select("key", "ts", F.unix_micros("ts").alias("micros"), "seq", "path").mapInArrow(pack, PACKED).withWatermark("ts", delay)
    return rows.groupBy("key").applyInPandasWithState(advance, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def deliver(batches: DataFrame, done: Table, failed: Table, act: Callable[[DataFrame], DataFrame], name: str):
    """Hand each micro-batch of ``batches`` to ``act`` and keep what it makes in ``done``. Where it fails, the rows go
    to ``failed`` with the error, and the next ones are handed over all the same. Both tables take a numbered
    batch once."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            done.append(act(batch), batch=(name, number))
        except Exception as error:  # whatever the caller's function raises
            failed.append(batch.withColumn("error", F.lit(f"{type(error).__name__}: {error}"[:500])), batch=(name, number))
        finally:
            batch.unpersist()

    return batches.writeStream.foreachBatch(apply).trigger(availableNow=True)
