"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context and only its text is
trainable. Turns are marked by control strings; whatever looks like a control string inside a text is
escaped, so that a text can't forge a turn and formatting can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
TRAINED = "assistant"
#: What may begin a control string: of this template (<|) and of common ones.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    """Double every backslash, then put one behind the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """Undo ``escape``: of each backslash and what follows it, only a second backslash stays."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: id_col, target, text, loss_start, loss_end, final.

    target is the place (from 1) of the trained turn; [loss_start, loss_end) are code points of
    ``text``. A conversation that doesn't end with an assistant turn has one more example, its whole
    text with nothing trained (target null). ``final`` marks the example with all of its turns.

    Turns are ordered by turn number (null first), then role and text; repeated rows are turns of
    their own. Null roles and texts are empty. Rows with a null id are one conversation. A
    conversation is held as a row; an example is made when its row is read, never all at once.
    Other columns are not read; an empty table gives an empty result.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    talks = turns.select(F.col(id_col).alias("id"), one.alias("one")).groupBy("id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    marked = F.transform("turns", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END)))
    talks = talks.select("id", F.col("turns.role").alias("roles"), marked.alias("parts"), F.size("turns").alias("n"))
    places = F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: (F.element_at("roles", k) == TRAINED) | (k == F.col("n")))
    rows = talks.select("id", "roles", "parts", "n", F.explode(places).alias("k"))
    rows = rows.select("id", "n", "k", F.element_at("roles", F.col("k")).alias("role"), F.element_at("parts", F.col("k")).alias("last"), F.array_join(F.slice("parts", F.lit(1), F.col("k")), "").alias("text"))
    trained = F.col("role") == TRAINED
    end = F.length("text") - len(END)
    start = F.length("text") - F.length("last") + F.length(F.substring_index("last", TEXT, 1)) + len(TEXT)
    return rows.select(
        F.col("id").alias(id_col),
        F.when(trained, F.col("k")).alias("target"),
        "text",
        F.when(trained, start).alias("loss_start"),
        F.when(trained, end).alias("loss_end"),
        (F.col("k") == F.col("n")).alias("final"),
    )


def read_turns(text: Column) -> Column:
    """The (role, text) turns of a formatted text."""
    parts = F.slice(F.split(text, r"<\|turn\|>"), 2, 1 << 30)
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, TEXT, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))


def read_back(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of the conversations as the examples hold them.

    id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. An example is reduced to
    its trained text, and the final one to its digest, before conversations meet."""
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    turns = read_turns(F.col("text"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = examples.select(
        F.col(id_col).alias("id"),
        F.when(F.col("target").isNotNull(), F.struct(F.col("target"), loss.alias("loss"))).alias("trained"),
        F.when(F.col("final"), F.size(turns).cast("long")).alias("n"),
        F.when(F.col("final"), F.sha2(told, 256)).alias("digest"),
        F.length("text").cast("long").alias("chars"),
    )
    talks = rows.groupBy("id").agg(F.max("n").alias("n_turns"), F.max("digest").alias("turns_sha256"), F.array_join(F.transform(F.sort_array(F.collect_list("trained")), lambda x: x["loss"]), "").alias("loss"), F.sum("chars").alias("formatted_chars"))
    return talks.select(F.col("id").alias(id_col), "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


PROBE = "</s>[INST] ok [/INST]"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that speaks in control strings, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(store(format_examples(turns.unionByName(probe)), "examples"))


OP8_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, count(*) over (partition by conv_id) as n,
         {len(TURN) + len(TEXT) + len(END)} + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g'))
           + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2', 'g')) as size
  from turns),
summed as (select *, sum(size) over (partition by conv_id order by k) as upto from placed)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
       length(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), ''))::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
       sum(upto) filter (role = 'assistant' or k = n)::bigint as formatted_chars
from summed group by conv_id
"""
