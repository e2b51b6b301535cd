"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source the documents are ordered by that key; prefix
sums of their word counts are computed in two levels (sums of key ranges, then rows within a range), so
that a source of any size is spread over many tasks; each source is cut at its exact budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A source is dealt to ranges of keys by their leading hexadecimal digits: three, and as many more as keep
#: a range, which is one window partition, under so many rows. The result doesn't depend on them.
RANGE_ROWS = 50_000
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The sources share ``share[0]/share[1]`` of all sizes by weight. A target stops at ``most`` times
    its source's size and the excess goes to the others by weight, until none is above. That fixed
    point is target = min(cap, level * weight); the level is the largest of the levels that arise when
    the k sources with the lowest cap per weight are full.
    One row for each source: the windows here run over source names, not over documents.
    """
    names = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(names) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn + 1)
    rows = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * most)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    still = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * share[0] - full * share[1]) / (still * share[1])
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(row, size, source_size, target, taken): the columns of ``docs`` as one struct, and the plan.

    ``taken`` counts the words that the mix takes from the document: whole epochs of the source, and
    of the last epoch what lies before the cut, in the order of the keys. The taken words of a source
    add up to its target, rounded down; no document exceeds ``most`` times its size.
    Null texts have size 0 and are never taken; null sources are a source of their own, last in order.
    Rows with one id are ordered by size; equal rows share their places, so reruns agree. Null ids
    share one key. An empty table gives an empty result; other columns stay inside ``row``.
    """
    key = F.md5(F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumns({"source": F.col(f"row.`{source_col}`"), "size": word_count(F.col(f"row.`{text_col}`")), "key": key})
    digits = max(3, math.ceil(math.log(max(docs.count(), 1) / range_rows, 16)))
    rows = rows.withColumn("part", F.conv(F.substring("key", 1, digits), 16, 10).cast("int"))
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    places = sums.select("source", "part", F.coalesce(before, F.lit(0)).alias("start"))
    places = places.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    places = places.select(F.col("source").alias("s"), F.col("part").alias("p"), "start", "source_size", "target")
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("source", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inner", inner).join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    rest = budget - whole * F.col("source_size")
    cut = F.least(F.greatest(rest - F.col("start") - F.col("inner"), F.lit(0)), F.col("size"))
    return placed.select("row", "size", "source_size", "target", (whole * F.col("size") + cut).alias("taken"), whole.alias("epochs"), cut.alias("last"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each document as often as the plan takes it.

    Documents stay whole here: the one at the cut is taken if at least half of its words lie before
    it. A document without words is not taken.
    """
    plan = mix_plan(docs, **options)
    copies = (F.col("epochs") + F.when((F.col("last") > 0) & (F.col("last") * 2 >= F.col("size")), 1).otherwise(0)) * (F.col("size") > 0).cast("int")
    return plan.select("row", F.explode(F.sequence(F.lit(0), copies.cast("int"))).alias("copy")).where("copy > 0").select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes from each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_plan(docs).select("row.doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as key from documents),
sources as (
  select source, sum(size)::bigint as source_size,
         [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as weight
  from sized group by source),
levels as (
  select *, (3 * sum(source_size) over () - 2 * coalesce(sum(2 * source_size) over (order by 2 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
         / (2 * sum(weight) over (order by 2 * source_size / weight, source nulls last rows between current row and unbounded following))::double as level
  from sources),
goals as (
  select source, source_size, least((2 * source_size)::double, max(level) over () * weight) as target from levels),
placed as (
  select r.doc_id, r.size, g.source_size, g.target,
         coalesce(sum(r.size) over (partition by r.source order by r.key, r.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from sized r join goals g on r.source is not distinct from g.source),
budgets as (
  select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from placed)
select doc_id, size, source_size, target,
       (epochs * size + least(greatest(floor(target)::bigint - epochs * source_size - start, 0), size))::bigint as taken
from budgets
"""
