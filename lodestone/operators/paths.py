"""Paths under aliases (links) and redirects (renames): chains, deletions, cycles, for all paths at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def chains(links: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """(source, at, hops, cycle): where each ``source`` of ``links`` (source, target; one target a source) ends,
    after how many hops, and whether it never does, since it leads into a cycle (then ``at`` is null).

    Pointers double: a round puts in place of each target what that target points to, so a chain of any length
    takes a logarithmic number of rounds. What still moves after more hops than there are links is on a cycle
    or leads to one. Chains end early at targets in ``stops`` (node).
    """
    now = cut(links.select("source", F.col("target").alias("at"), F.lit(1).cast("long").alias("hops")))
    count, reach = now.count(), 1
    while True:
        onward = now.select(F.col("source").alias("at"), F.col("at").alias("further"), F.col("hops").alias("more"))
        if stops is not None:
            onward = onward.join(stops.select(F.col("node").alias("at")), "at", "left_anti")
        moved = now.join(onward, "at", "left")
        moves = F.col("further").isNotNull()
        after = cut(moved.select("source", F.coalesce("further", "at").alias("at"), F.when(moves, F.col("hops") + F.col("more")).otherwise(F.col("hops")).alias("hops"), moves.alias("moves")), now)
        if after.where("moves").isEmpty() or reach >= count:
            return after.select("source", F.when(~F.col("moves"), F.col("at")).alias("at"), F.when(~F.col("moves"), F.col("hops")).alias("hops"), F.col("moves").alias("cycle"))
        now, reach = after.drop("moves"), 2 * reach
        now._cut_at = after._cut_at


def _prefixes(path: Column) -> Column:
    """A path and its folders, each with whether it is the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("from"), (k == F.size(parts)).alias("whole")))


def _mapped(rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """``rows`` with ``to`` and ``hit`` of the longest of ``mappings`` (from, to, kind: file or directory) that fits
    their path: its own, or, of a directory, one above it. ``to`` is the whole new path, null where that is gone."""
    met = rows.select("input", "path", F.explode(_prefixes(F.col("path"))).alias("p")).select("input", "path", "p.from", "p.whole").join(mappings, "from")
    met = met.where("whole or kind = 'directory'").groupBy("input").agg(F.max(F.struct(F.length("from").alias("n"), F.col("to").isNotNull().alias("there"), F.expr("to || substr(path, length(from) + 1)").alias("to"))).alias("b"))
    return rows.join(met.select("input", F.col("b.to").alias("to"), F.lit(True).alias("hit")), "input", "left")


def resolve(inputs: DataFrame, aliases: DataFrame, redirects: DataFrame) -> DataFrame:
    """(input, path, state, aliased, redirected) of each of ``inputs`` (input), all different, relative and
    normalised.

    As long as one fits, the longest alias and then the longest redirect (from, to, kind; no two of one ``from`` in
    both together) is put in place. The end is ``current``, or ``deleted`` where a redirect has no ``to``, or a ``cycle``
    (path null). Chains of renamed files are followed as one step (``chains``); so the rounds are as many as
    there are changes between links, folders and files on the longest way, whatever the length of chains.
    """
    files = redirects.where("kind = 'file'")
    links = files.where("to is not null").select(F.col("from").alias("source"), F.col("to").alias("target"))
    # a chain pauses where an alias applies
    ends = links.select(F.col("target").alias("input"), F.col("target").alias("path")).distinct()
    paused = _mapped(ends, aliases).where("hit").select(F.col("input").alias("node"))
    whole = cut(chains(links, paused))
    gone = files.where("to is null").select(F.col("from").alias("path"), F.lit(True).alias("gone"))
    folders = redirects.where("kind = 'directory'")
    now = cut(inputs.select("input", F.col("input").alias("path"), F.array("input").alias("seen"), F.lit(False).alias("aliased"), F.lit(False).alias("redirected")))
    done = []
    while True:
        linked = _mapped(now, aliases)
        linked = linked.select("input", F.col("path").alias("before"), F.when(F.col("hit"), F.col("to")).otherwise(F.col("path")).alias("path"), "seen", (F.col("aliased") | F.col("hit").isNotNull()).alias("aliased"), "redirected", F.col("hit").isNotNull().alias("changed"))
        linked = linked.withColumn("looped", F.col("changed") & F.array_contains("seen", F.col("path"))).withColumn("seen", F.when(F.col("changed"), F.concat("seen", F.array("path"))).otherwise(F.col("seen")))
        named = linked.join(whole.select(F.col("source").alias("path"), "at", "cycle"), "path", "left").join(gone, "path", "left")
        # no folder has a longer name than the path itself, so a file's own redirect comes first
        moved = _mapped(named, folders)
        to = F.when(F.col("at").isNotNull(), F.col("at")).when(F.col("gone").isNull() & F.col("cycle").isNull(), F.col("to"))
        dead = F.col("gone").isNotNull() | (F.col("hit").isNotNull() & F.col("to").isNull() & F.col("cycle").isNull())
        step = moved.withColumn("next", to).withColumn("looped", F.col("looped") | F.coalesce("cycle", F.lit(False)) | F.coalesce(F.array_contains("seen", F.col("next")), F.lit(False)))
        state = F.when(F.col("looped"), "cycle").when(dead, "deleted").when(~F.col("changed") & F.col("next").isNull(), "current")
        step = cut(step.select("input", F.when(F.col("looped"), F.lit(None)).otherwise(F.coalesce("next", "path")).alias("path"), F.when(F.col("next").isNotNull(), F.concat("seen", F.array("next"))).otherwise(F.col("seen")).alias("seen"), "aliased", (F.col("redirected") | dead | F.col("next").isNotNull()).alias("redirected"), state.alias("state")))
        done.append(step.where("state is not null").select("input", "path", "state", "aliased", "redirected"))
        now = step.where("state is null").drop("state")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, done)
