"""A positional index: where each word occurs, by line and place, and the lines around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_table

#: A word is a run of letters, digits, ``_`` and ``$``; a search for one meets nothing within a longer one.
WORD = r"[\p{L}\p{N}_$]+"
#: Places that the postings of one word go to, so that a frequent one is no single task's.
SPREAD = 16


class PositionalIndex:
    """Postings (word, doc, line, place), dealt and sorted by word, and lines (doc, line, text), by document.
    Lines count from 1, places are the numbers of words in a line, from 1."""

    def __init__(self, postings: DataFrame, lines: DataFrame):
        self.postings, self.lines = postings, lines

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text: Column) -> PositionalIndex:
        """Of documents with different ids; null texts have no lines."""
        rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
        lines = shared_table(rows.repartition("doc").sortWithinPartitions("doc", "line"), "lines")
        words = lines.select("doc", "line", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("place", "word"))
        words = words.select("word", "doc", "line", (F.col("place") + 1).alias("place"))
        dealt = words.repartition(F.col("word"), F.pmod(F.xxhash64("doc"), F.lit(SPREAD)))
        return cls(shared_table(dealt.sortWithinPartitions("word"), "places"), lines)

    def hits(self, symbols: DataFrame) -> DataFrame:
        """(symbol, doc, line, places) of the lines with ``symbols`` (symbol, defined), but for those of the
        document that defines it; ``places`` is how many there are in the line."""
        met = self.postings.join(symbols.select(F.col("symbol").alias("word"), "defined"), "word").where(~F.col("doc").eqNullSafe(F.col("defined")))
        return met.groupBy(F.col("word").alias("symbol"), "doc", "line").agg(F.count("*").alias("places"))

    def grep(self, symbols: DataFrame, context: int = 2) -> DataFrame:
        """(symbol, doc, matches, first_line, context): per document the lines that match, and those within
        ``context`` of one, each once, in order. A document's lines move once, to where its hits are."""
        hits = self.hits(symbols).groupBy("symbol", "doc").agg(F.count("*").alias("matches"), F.min("line").alias("first_line"), F.collect_list("line").alias("at"))
        texts = self.lines.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("texts"))
        near = F.flatten(F.transform("at", lambda n: F.sequence(F.greatest(n - context, F.lit(1)), F.least(n + context, F.size("texts")))))
        text = F.array_join(F.transform(F.array_sort(F.array_distinct(near)), lambda n: F.get("texts", n - 1)), "\n")
        return hits.join(texts.hint("merge"), "doc").select("symbol", "doc", "matches", "first_line", text.alias("context"))

    def near(self, symbols: DataFrame, bits: DataFrame, context: int = 2) -> DataFrame:
        """(defined, block, mask): which words of ``bits`` (word, block, bit) occur in the contexts that ``grep`` would
        show. A line's words meet the hits around it as bits; no text moves."""
        told = self.postings.join(bits, "word").groupBy("doc", "line", "block").agg(F.bit_or("bit").alias("mask"))
        hits = self.postings.join(symbols.select(F.col("symbol").alias("word"), "defined"), "word").where(~F.col("doc").eqNullSafe(F.col("defined"))).select("defined", "doc", "line").distinct()
        around = hits.select("defined", "doc", F.explode(F.sequence(F.col("line") - context, F.col("line") + context)).alias("line")).distinct()
        return around.join(told, ["doc", "line"]).groupBy("defined", "block").agg(F.bit_or("mask").alias("mask"))

    def call_sites(self, symbols: DataFrame, most: int = 20, context: int = 2) -> DataFrame:
        """``grep`` of each symbol's ``most`` best documents, with their ``rank``: by matches, then by id. Lines
        are fetched for those only."""
        hits = self.hits(symbols)
        counts = hits.groupBy("symbol", "doc").agg(F.count("*").alias("matches"))
        best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("matches"), "doc"))).where(F.col("rank") <= most)
        near = hits.join(best.select("symbol", "doc"), ["symbol", "doc"]).select("symbol", "doc", F.explode(F.sequence(F.col("line") - context, F.col("line") + context)).alias("line")).distinct()
        shown = near.join(self.lines, ["doc", "line"]).groupBy("symbol", "doc").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("shown"))
        return best.join(shown, ["symbol", "doc"]).select("symbol", "rank", "doc", "matches", F.array_join(F.transform("shown", lambda x: x["text"]), "\n").alias("context"))

    def unseen(self, symbols: DataFrame) -> DataFrame:
        """The ``symbols`` (symbol, defined) that no other document holds."""
        return symbols.join(self.hits(symbols).select("symbol").distinct(), "symbol", "left_anti")
