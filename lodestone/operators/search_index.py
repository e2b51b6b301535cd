"""An inverted index that is kept up to date: segments, tombstones, and statistics that add up.

A write adds a segment: postings of the documents that came, a forward entry for each of them, tombstones
for the entries that they or a deletion put out of use, and signed document frequencies. A search reads the
postings of its terms in all segments but those that a tombstone names; document counts, lengths and
frequencies are sums over segments, so scores are those of an index built anew over what is there now.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..shared import cut, delete
from .retrieval import bm25
from .store import Table

#: Places that the postings of one term go to, so that a frequent one is no single task's.
SPREAD = 16
COMMIT = "segment long, base boolean, docs long, tokens long"


class SearchIndex:
    """An index at ``path`` over documents with ids of type ``kind``.

    A segment counts once its commit is there (``Table``), which is written last: a write that dies leaves
    nothing that a search sees, and one with a ``batch`` that was applied before does nothing.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        self.commits = Table(spark, f"{self.path}/commits")
        self.schemas = {
            "postings": f"term string, doc {kind}, tf bigint, dl int",
            "forward": f"doc {kind}, digest string, dl int, terms array<string>",
            "tombstones": f"doc {kind}, dead bigint",
            "frequencies": "term string, df bigint",
        }

    # --- reading

    def _log(self) -> list:
        """The commits that count: since the last one that stands for all before it. A row a write."""
        if self.commits.current() is None:
            return []
        log = sorted(self.commits.read().collect(), key=lambda r: r["segment"])
        bases = [k for k, r in enumerate(log) if r["base"]]
        return log[bases[-1] :] if bases else log

    def _read(self, name: str, log: list) -> DataFrame:
        parts = [self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}/{r['segment']}").withColumn("segment", F.lit(r["segment"]).cast("long")) for r in log]
        if not parts:
            return self.spark.createDataFrame([], self.schemas[name] + ", segment bigint")
        while len(parts) > 1:  # a balanced tree of unions
            parts = [parts[k].unionByName(parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def _live(self, name: str, log: list) -> DataFrame:
        dead = self._read("tombstones", log).select("doc", F.col("dead").alias("segment"))
        return self._read(name, log).join(dead, ["doc", "segment"], "left_anti")

    def postings(self) -> DataFrame:
        """(term, doc, tf, dl) of the documents that are there."""
        return self._live("postings", self._log()).drop("segment")

    def documents(self) -> DataFrame:
        """(doc, digest, dl) of the documents that are there."""
        return self._live("forward", self._log()).select("doc", "digest", "dl")

    def frequencies(self) -> DataFrame:
        """(term, df) of the terms that occur."""
        return self._read("frequencies", self._log()).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def statistics(self, log: list | None = None) -> tuple[int, float]:
        """(documents, average length)."""
        log = self._log() if log is None else log
        n, all_ = sum(r["docs"] for r in log), sum(r["tokens"] for r in log)
        return n, all_ / n if n else 0.0

    def search(self, terms: list[str]) -> DataFrame:
        """(doc, score) of the documents that hold any of ``terms``; more negative is better. Document counts
        and the average length are of the whole store."""
        log, wanted = self._log(), list(dict.fromkeys(terms))
        n, length = self.statistics(log)
        hits = self._live("postings", log).where(F.col("term").isin(wanted))
        weights = self._read("frequencies", log).where(F.col("term").isin(wanted)).groupBy("term").agg(F.sum("df").alias("df"))
        weights = weights.withColumn("n", F.lit(n)).withColumn("avgdl", F.lit(length))  # a row for each term of the query
        return bm25(hits.join(F.broadcast(weights), "term"))

    # --- writing

    def _segment(self, came: DataFrame | None, gone: DataFrame | None, batch: tuple[str, int] | None, base: bool = False) -> None:
        """Commit documents that ``came`` (doc, digest, t) and entries ``gone`` (doc, segment, dl, terms)."""
        log = self._log()
        number = max((r["segment"] for r in log), default=-1) + 1
        write = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/{number}")
        empty = lambda name: self.spark.createDataFrame([], self.schemas[name])
        if came is None:
            write(empty("forward"), "forward")
            write(empty("postings"), "postings")
        else:
            write(came.select("doc", "digest", F.size("t").alias("dl"), F.array_distinct("t").alias("terms")), "forward")
            tf = came.select("doc", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
            dealt = tf.select("term", "doc", "tf", "dl").repartition(F.col("term"), F.pmod(F.xxhash64("doc"), F.lit(SPREAD)))
            write(dealt.sortWithinPartitions("term"), "postings")
        write(gone.select("doc", F.col("segment").alias("dead")) if gone is not None else empty("tombstones"), "tombstones")
        new = self.spark.read.schema(self.schemas["postings"]).parquet(f"{self.path}/postings/{number}").select("term", F.lit(1).alias("df"))
        old = gone.select(F.explode("terms").alias("term"), F.lit(-1).alias("df")) if gone is not None else new.limit(0)
        write(new.unionByName(old).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").repartitionByRange("term").sortWithinPartitions("term"), "frequencies")
        forward = self.spark.read.schema(self.schemas["forward"]).parquet(f"{self.path}/forward/{number}")
        plus = forward.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        less = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first() if gone is not None else (0, 0)
        self.commits.append(self.spark.createDataFrame([(number, base, plus[0] - less[0], plus[1] - less[1])], COMMIT), batch)

    def upsert(self, docs: DataFrame, id_col: str, text: Column, batch: tuple[str, int] | None = None) -> None:
        """Add documents; those with ids that are there take their places. Of rows that repeat an id, one with
        the least text counts; null ids are left out, null texts are empty."""
        if self.commits.applied(batch):
            return
        self._upsert(cut(self._read_in(docs, id_col, text)), batch)

    @staticmethod
    def _read_in(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
        rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(text, F.lit("")).alias("text")).where("doc is not null")
        rows = rows.groupBy("doc").agg(F.min("text").alias("text"))
        return rows.select("doc", F.sha2("text", 256).alias("digest"), tokens(F.col("text")).alias("t"))

    def _upsert(self, came: DataFrame, batch: tuple[str, int] | None, also: DataFrame | None = None) -> None:
        live = self._live("forward", self._log())
        hit = came.select("doc") if also is None else came.select("doc").unionByName(also.select("doc"))
        gone = cut(live.join(hit, "doc", "left_semi").select("doc", "segment", "dl", "terms"))
        self._segment(came, gone, batch)
        for df in (came, gone):
            delete(self.spark, df._cut_at)

    def delete(self, gone: DataFrame, key: str = "key", batch: tuple[str, int] | None = None) -> None:
        """Take out the documents whose ids are in ``key`` of ``gone``."""
        if self.commits.applied(batch):
            return
        hit = gone.select(F.col(key).alias("doc"))
        dead = cut(self._live("forward", self._log()).join(hit, "doc", "left_semi").select("doc", "segment", "dl", "terms"))
        self._segment(None, dead, batch)
        delete(self.spark, dead._cut_at)

    def refresh(self, docs: DataFrame, id_col: str, text: Column) -> tuple[int, int]:
        """Make the index hold exactly ``docs``: (documents written, documents taken out). What has the digest
        that is stored is left alone; where nothing differs, nothing is written."""
        now = self._read_in(docs, id_col, text)
        there = self.documents().select("doc", F.col("digest").alias("stored"))
        differs = cut(now.join(there, "doc", "left").where(~F.col("digest").eqNullSafe(F.col("stored"))).drop("stored"))
        missing = cut(there.join(docs.select(F.col(id_col).alias("doc")), "doc", "left_anti").select("doc"))
        counts = differs.count(), missing.count()
        if any(counts):
            self._upsert(differs, None, missing)
        else:
            delete(self.spark, differs._cut_at)
        delete(self.spark, missing._cut_at)
        return counts

    def compact(self) -> None:
        """One segment of all that is there; what older segments hold is no longer read."""
        log = self._log()
        if len(log) < 2:
            return
        number = max(r["segment"] for r in log) + 1
        write = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/{number}")
        dealt = self._live("postings", log).drop("segment").repartition(F.col("term"), F.pmod(F.xxhash64("doc"), F.lit(SPREAD)))
        write(dealt.sortWithinPartitions("term"), "postings")
        write(self._live("forward", log).drop("segment"), "forward")
        write(self.spark.createDataFrame([], self.schemas["tombstones"]), "tombstones")
        write(self.frequencies().repartitionByRange("term").sortWithinPartitions("term"), "frequencies")
        totals = (sum(r["docs"] for r in log), sum(r["tokens"] for r in log))
        self.commits.append(self.spark.createDataFrame([(number, True, *totals)], COMMIT))
