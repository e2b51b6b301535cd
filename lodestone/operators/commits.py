"""Commits of file records: checked against the version they expect, merged field by field, held to an identity,
and written with a row of history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Table, first_wins

# The fields of a version, by their names in it, and what an empty one is.
VERSIONED = {
    "blurb": ("blurb", "''"), "cluster": ("cluster", None), "conventions": ("conventions", "array()"), "dataFlows": ("data_flows", "array()"), "fileHash": ("file_hash", None), "filePath": ("file_path", None), "hazards": ("hazards", "array()"),
    "keyTypes": ("key_types", "array()"), "patterns": ("patterns", "array()"), "publicApi": ("public_api", "array()"), "purpose": ("purpose", "''"), "rangedHazards": ("ranged_hazards", "array()"), "sourceHighlights": ("source_highlights", "array()"), "tags": ("tags", "array()"), "workspace": ("workspace", None),
}
#: What a commit may set; null leaves what is stored. Texts are trimmed, and an empty one counts as none.
TEXTS = ("purpose", "blurb", "cluster")
LISTS = ("tags", "conventions", "key_types", "data_flows", "public_api", "source_highlights", "patterns", "hazards")
#: What a record must have after a commit.
IDENTITY = {"purpose": "purpose", "blurb": "blurb", "tags": "tags", "sourceHighlights": "source_highlights"}
NOTHING = "sha256:" + "74234e98afe7498fb5daf1f36ac2d78acc339464f950703b8c019892f982b90b"


def version(field=F.col) -> Column:
    """The digest of a record's fifteen fields, as JSON with sorted keys and nulls told. ``field`` gives the column
    of each name."""
    told = [field(c).alias(k) if empty is None else F.coalesce(field(c), F.expr(empty)).alias(k) for k, (c, empty) in VERSIONED.items()]
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*told), {"ignoreNullFields": "false"}), 256))


def judge(existing: DataFrame, commits: DataFrame) -> DataFrame:
    """``commits`` (workspace, file_path, summary, expected, evidence, TEXTS, LISTS) against the records that exist:
    status, current and new version, missing identity fields, updated fields, and the merged record as ``record``.

    A commit whose ``expected`` is not null and not the current version (that of no record, where there is none) is a
    ``conflict``; one that leaves the record without purpose, blurb, tags or highlights is ``rejected``; else it is
    ``committed``. ``evidence`` tells the authorities of what supports it.
    """
    old, new = existing.alias("o"), commits.alias("n")
    joined = new.join(old, (F.col("n.workspace") == F.col("o.workspace")) & (F.col("n.file_path") == F.col("o.file_path")), "left")
    there = F.col("o.file_path").isNotNull()
    current = F.when(there, version(lambda c: F.col(f"o.{c}"))).otherwise(NOTHING)
    given = {c: F.nullif(F.trim(f"n.{c}"), F.lit("")) if c in TEXTS else F.col(f"n.{c}") for c in (*TEXTS, *LISTS)}
    merged = {c: F.coalesce(g, F.col(f"o.{c}")) for c, g in given.items()}
    record = F.struct(F.col("n.workspace").alias("workspace"), F.col("n.file_path").alias("file_path"), *[F.col(f"o.{c}").alias(c) for c in ("file_hash", "ranged_hazards")], *[m.alias(c) for c, m in merged.items()])
    lacks = {k: F.coalesce(F.trim(merged[c]), F.lit("")) == "" if c in TEXTS else F.coalesce(F.size(merged[c]), F.lit(0)) <= 0 for k, c in IDENTITY.items()}
    missing = F.array_compact(F.array(*[F.when(cond, k) for k, cond in lacks.items()]))
    names = {"changelog": F.lit(True), "evidence": F.size("n.evidence") > 0} | {next(k for k, (v, _) in VERSIONED.items() if v == c): F.col(f"n.{c}").isNotNull() for c in given}
    updated = F.array_sort(F.array_compact(F.array(*[F.when(cond, k) for k, cond in names.items()])))
    rows = joined.select("n.workspace", "n.file_path", "n.summary", "n.number", current.alias("current"), record.alias("record"), missing.alias("missing"), updated.alias("updated"), F.col("n.expected").alias("expected"), F.when(F.array_contains("n.evidence", "verified-external"), "verified").otherwise("pending").alias("verification"))
    status = F.when(F.col("expected").isNotNull() & (F.col("expected") != F.col("current")), "conflict").when(F.size("missing") > 0, "rejected").otherwise("committed")
    return rows.withColumn("status", status).withColumn("version", F.when(F.col("status") == "committed", version(lambda c: F.col(f"record.{c}"))).otherwise(F.col("current")))


def history(judged: DataFrame) -> DataFrame:
    """The rows of history of what was committed."""
    return judged.where("status = 'committed'").select("workspace", "file_path", "summary", F.col("record.cluster").alias("cluster"), "number", "version", F.array_join("updated", ",").alias("updated"), F.col("verification").alias("verification_status"))


def commit(files: Table, log: Table, commits: DataFrame, batch: tuple[str, int]) -> DataFrame:
    """Judge a batch against ``files`` and write its history to ``log`` and its records; what was judged.

    Of several commits of one file the first by ``number`` counts. Both tables take a batch once, and records come
    last: a batch that died between the two writes is judged again by the same records and leaves one row of
    history a commit."""
    known = files.read()
    judged = judge(known, first_wins(commits, ["workspace", "file_path"], "number"))
    log.append(history(judged), batch=batch)
    files.upsert(judged.where("status = 'committed'").select("record.*").select(*known.columns), batch=batch)
    return judged
