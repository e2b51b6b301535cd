"""Keyed writes over Parquet tables: a new version of a table is computed, written aside, and put in place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows whose key doesn't come in, and all incoming ones."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def merge_scan(existing: DataFrame, scanned: DataFrame, keys: list[str], hash_col: str, reset: list[str]) -> DataFrame:
    """A structural scan over stored records: what the scan knows replaces the stored value, what it
    doesn't know stays, and ``reset`` columns are cleared where the hash differs (null-safe)."""
    known = [c for c in scanned.columns if c not in keys]
    other = [c for c in existing.columns if c not in keys and c not in known]
    old, new = existing.alias("o"), scanned.alias("n")
    joined = old.join(new, keys, "full")
    changed = ~F.col(f"o.{hash_col}").eqNullSafe(F.col(f"n.{hash_col}")) & F.col(f"n.{hash_col}").isNotNull()
    values = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in known]
    kept = [F.when(changed, F.lit(None)).otherwise(F.col(f"o.{c}")).alias(c) if c in reset else F.col(f"o.{c}") for c in other]
    return joined.select(*keys, *values, *kept)


def replace_for(existing: DataFrame, incoming: DataFrame, key: str, scope: DataFrame) -> DataFrame:
    """All rows of the keys in ``scope`` are replaced by the incoming ones."""
    return existing.join(scope.select(key).distinct(), key, "left_anti").unionByName(incoming)


def delete_keys(table: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose ``columns`` is among the deleted keys (column key)."""
    for c in columns:
        table = table.join(gone.select(F.col("key").alias(c)), c, "left_anti")
    return table


def first_wins(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def append_changed(versions: DataFrame, key: str, order: list[str], hash_col: str) -> DataFrame:
    """Versions that differ from the one before them."""
    before = F.lag(hash_col).over(Window.partitionBy(key).orderBy(*order))
    return versions.withColumn("__before", before).where(~F.col("__before").eqNullSafe(F.col(hash_col))).drop("__before")


def apply_commits(existing: DataFrame, commits: DataFrame, key: str, fields: list[str], version: str) -> DataFrame:
    """Commits (key, expected, fields) judged against stored records: key, status and merged fields.

    A field is taken from the commit, else from the record; a commit whose expected version differs
    from the record's is a conflict; one that leaves an identity field empty is rejected."""
    old, new = existing.alias("o"), commits.alias("n")
    joined = new.join(old, key, "left")
    merged = {f: F.coalesce(F.col(f"n.{f}"), F.col(f"o.{f}")) for f in fields}
    empty = F.lit(False)
    for value in merged.values():
        empty = empty | F.coalesce(value, F.lit("")).eqNullSafe("")
    conflict = F.col("n.expected").isNotNull() & ~F.col("n.expected").eqNullSafe(F.col(f"o.{version}"))
    status = F.when(conflict, "conflict").when(empty, "rejected").otherwise("applied")
    return joined.select(key, status.alias("status"), *[v.alias(f) for f, v in merged.items()])


def replay(commands: DataFrame, done: DataFrame) -> DataFrame:
    """Commands (key, payload_hash) against those done (key, payload_hash): fresh, replayed, conflict."""
    seen = done.select("key", F.col("payload_hash").alias("__done"))
    status = F.when(F.col("__done").isNull(), "fresh").when(F.col("__done") == F.col("payload_hash"), "replayed").otherwise("conflict")
    return commands.join(seen, "key", "left").withColumn("status", status).drop("__done")


def select_records(candidates: DataFrame, order: str, stale: bool = False, historical: bool = False) -> DataFrame:
    """Candidates (identity, path_state, indexed_hash, current_hash, completeness, indexed_at, ``order``) with
    quality and reason; the one of each identity whose reason is null is selected.

    Records without an identity, without a current source or with another hash than the source's are left
    out (the last two unless asked for). Of the rest the best quality wins, then the surer path, the more
    complete, the newer, the earlier candidate.
    """
    known = (F.trim(F.coalesce("indexed_hash", F.lit(""))) != "") & (F.trim(F.coalesce("current_hash", F.lit(""))) != "")
    quality = F.when(F.col("path_state") == "missing", "historical").when(known & (F.col("indexed_hash") != F.col("current_hash")), "stale_advisory").when(known & (F.col("path_state") == "current"), "current").otherwise("unverified")
    rows = candidates.withColumn("identity", F.trim(F.coalesce("identity", F.lit("")))).withColumn("quality", quality)
    why = F.when(F.col("identity") == "", "invalid_identity")
    if not historical:
        why = why.when(F.col("path_state") == "missing", "missing_current_source")
    if not stale:
        why = why.when(F.col("quality") == "stale_advisory", "stale_hash")
    rows = rows.withColumn("reason", why)
    place = lambda c, *names: F.coalesce(*[F.when(F.col(c) == n, k) for k, n in enumerate(names)])
    best = Window.partitionBy("identity", F.col("reason").isNull()).orderBy(
        place("quality", "current", "unverified", "stale_advisory", "historical"), place("path_state", "current", "unknown", "missing"), F.desc(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "completeness"))), F.desc_nulls_last("indexed_at"), order
    )
    return rows.withColumn("reason", F.coalesce("reason", F.when(F.row_number().over(best) > 1, "duplicate_lower_quality")))


class Table:
    """A Parquet table with numbered versions, dealt to buckets by its keys.

    A write puts new files aside and then a manifest with the next number; the table is what the manifest
    with the highest number lists. Nothing that a manifest lists is changed or deleted, so readers see one
    version or the next, and a write that dies at any point changes nothing. Two writers of one number:
    the second fails. An upsert rewrites the buckets that its keys fall into, not the table.

    A write may carry a batch (stream's name, number): the manifest remembers the last one of each stream,
    and a batch that was applied before is skipped. That makes a repeated micro-batch harmless.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys or [], buckets if keys else 1
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def manifest(self) -> dict | None:
        """What the newest manifest says; None for a table that was never written."""
        for number in self._numbers():
            stream = self._fs.open(self._path(f"{self.path}/_manifests/{number:012d}"))
            try:
                return json.loads(bytes(stream.readAllBytes()).decode()) | {"number": number}
            finally:
                stream.close()
        return None

    def current(self) -> int | None:
        known = self.manifest()
        return known and known["number"]

    def applied(self, batch: tuple[str, int] | None) -> bool:
        known = self.manifest()
        return bool(batch and known and known["batches"].get(batch[0], -1) >= batch[1])

    def read(self) -> DataFrame:
        known = self.manifest()
        if known is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._rows(known, known["parts"])

    def _rows(self, known: dict, buckets) -> DataFrame:
        schema = StructType.fromJson(known["schema"])
        paths = [f"{self.path}/{p}" for b in buckets for p in known["parts"].get(str(b), [])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def _put(self, df: DataFrame) -> dict[str, list[str]]:
        """Files of ``df``, by bucket."""
        version = f"v={uuid.uuid4().hex}"
        dealt = df.withColumn("__bucket", self._bucket())
        if self.keys:
            dealt = dealt.repartition(self.buckets, "__bucket")
        dealt.write.partitionBy("__bucket").parquet(f"{self.path}/{version}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{version}"))]
        return {n.partition("=")[2]: [f"{version}/{n}"] for n in names if n.startswith("__bucket=")}

    def _commit(self, number: int, schema: StructType, parts: dict[str, list[str]], known: dict | None, batch: tuple[str, int] | None) -> int:
        batches = dict(known["batches"]) if known else {}
        if batch:
            batches[batch[0]] = batch[1]
        said = json.dumps({"schema": json.loads(schema.json()), "parts": parts, "batches": batches}).encode()
        aside, place = (self._path(f"{self.path}/_manifests/{n}") for n in (f"_{uuid.uuid4().hex}", f"{number:012d}"))
        stream = self._fs.create(aside, False)
        stream.write(bytearray(said))
        stream.close()
        if self._fs.exists(place) or not self._fs.rename(aside, place):
            self._fs.delete(aside, False)
            raise RuntimeError(f"version {number} of {self.path} was written by another")
        return number

    def write(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """``df`` as the whole table."""
        known = self.manifest()
        if self.applied(batch):
            return known["number"]
        return self._commit((known["number"] if known else 0) + 1, df.schema, self._put(df), known, batch)

    def append(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """More rows."""
        known = self.manifest()
        if self.applied(batch):
            return known["number"]
        parts, new = dict(known["parts"]) if known else {}, self._put(df)
        return self._commit((known["number"] if known else 0) + 1, df.schema, {b: [*parts.get(b, []), *new.get(b, [])] for b in {*parts, *new}}, known, batch)

    def upsert(self, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame] | None = None, batch: tuple[str, int] | None = None) -> int:
        """Rows of ``incoming`` in place of those with their keys; or ``combine(stored, incoming)``, which
        must keep every row in its bucket."""
        known = self.manifest()
        if self.applied(batch):
            return known["number"]
        combine = combine or (lambda old, new: upsert(old, new, self.keys))
        if known is None:
            empty = self.spark.createDataFrame([], incoming.schema)
            return self._commit(1, incoming.schema, self._put(combine(empty, incoming)), None, batch)
        touched = [r[0] for r in incoming.select(self._bucket()).distinct().collect()]  # at most ``buckets``
        new = self._put(combine(self._rows(known, touched), incoming)) if touched else {}
        parts = {b: p for b, p in known["parts"].items() if int(b) not in touched}
        return self._commit(known["number"] + 1, StructType.fromJson(known["schema"]), parts | new, known, batch)
