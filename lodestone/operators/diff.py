"""Line differences of text versions: an Arrow kernel, one pair at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOK_AHEAD = 20


def opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """('=', i, j), ('-', i, j) or ('+', i, j) by line. Greedy: where lines differ, the nearest line of
    either side that the other has within LOOK_AHEAD lines decides what was removed or added."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(("=", i, j))
            i, j = i + 1, j + 1
            continue
        for gap in range(1, LOOK_AHEAD + 1):
            if i + gap < len(a) and a[i + gap] == b[j]:
                out += [("-", k, j) for k in range(i, i + gap)]
                i += gap
                break
            if j + gap < len(b) and a[i] == b[j + gap]:
                out += [("+", i, k) for k in range(j, j + gap)]
                j += gap
                break
        else:
            out += [("-", i, j), ("+", i, j)]
            i, j = i + 1, j + 1
    out += [("-", k, j) for k in range(i, len(a))]
    out += [("+", len(a), k) for k in range(j, len(b))]
    return out


def unified(a: list[str], b: list[str], context: int = 3) -> list[str]:
    """Hunks with ``context`` lines around the changes; equal texts have none."""
    ops = opcodes(a, b)
    hot = [k for k, (kind, _, _) in enumerate(ops) if kind != "="]
    out: list[str] = []
    at = 0
    while at < len(hot):
        first = max(0, hot[at] - context)
        end = hot[at]
        while at < len(hot) and hot[at] <= end + 2 * context + 1:
            end = hot[at]
            at += 1
        part = ops[first : end + context + 1]
        removed, added = sum(k != "+" for k, _, _ in part), sum(k != "-" for k, _, _ in part)
        out.append(f"@@ -{part[0][1] + (removed > 0)},{removed} +{part[0][2] + (added > 0)},{added} @@")
        out += [(" " if k == "=" else k) + (b[j] if k == "+" else a[i]) for k, i, j in part]
    return out


def apply(a: list[str], patch: list[str]) -> list[str]:
    """The new text from the old one and a unified diff."""
    out, at = [], 0
    for line in patch:
        if line.startswith("@@ "):
            start, count = (int(x) for x in line.split(" ")[1][1:].split(","))
            begin = start - (count > 0)
            out += a[at:begin]
            at = begin
        elif line[0] == "+":
            out.append(line[1:])
        else:
            if line[0] == " ":
                out.append(line[1:])
            at += 1
    return out + a[at:]


def diff(pairs: DataFrame, key: str, old: str, new: str, context: int = 3) -> DataFrame:
    """(key, insertions, deletions, patch) for each pair of texts; null texts are empty."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            added, removed, patches = [], [], []
            for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True):
                left, right = (a or "").split("\n"), (b or "").split("\n")
                ops = [] if a == b else opcodes(left, right)
                added.append(sum(k == "+" for k, _, _ in ops))
                removed.append(sum(k == "-" for k, _, _ in ops))
                patches.append("\n".join(unified(left, right, context)) if ops else "")
            yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(added, pa.int64()), pa.array(removed, pa.int64()), pa.array(patches, pa.string())], [key, "insertions", "deletions", "patch"])

    rows = pairs.select(F.col(key).alias("k"), F.col(old).alias("a"), F.col(new).alias("b"))
    return rows.mapInArrow(run, f"{key} {kind}, insertions bigint, deletions bigint, patch string")


def endpoint(snapshots: DataFrame, kind: str, value: object = None) -> DataFrame:
    """(file_path, id, content) of each file at an endpoint of its versions (id, file_path, created_at,
    content): ``id``, ``timestamp`` (the newest at or before it), ``latest``, ``prev`` (the newest that is
    strictly older than the latest; none if all are of one instant)."""
    newest = lambda rows: rows.groupBy("file_path").agg(F.max_by(F.struct("id", "content"), F.struct("created_at", "id")).alias("x")).select("file_path", "x.id", "x.content")
    if kind == "id":
        return snapshots.where(F.col("id") == value).select("file_path", "id", "content")
    if kind == "timestamp":
        return newest(snapshots.where(F.col("created_at") <= value))
    if kind == "latest":
        return newest(snapshots)
    if kind == "prev":
        last = snapshots.groupBy("file_path").agg(F.max("created_at").alias("last"))
        return newest(snapshots.join(last, "file_path").where("created_at < last"))
    raise ValueError(f"unknown endpoint {kind}")
