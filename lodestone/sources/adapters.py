"""The engine's frames over the driver's tables.

Each frame is a view of generic tables as the entities, edges, events and versions that the operators
work on. ``SQL`` holds the same definitions for the oracle; ``with_views`` puts those it needs before a
statement.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A text's first three words.
WORDS = r"^\W*(\w+)\W+(\w+)\W+(\w+)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, as an indexed file."""
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    rows = d.join(labels, "doc_id", "left")
    i = F.col("doc_id")
    folder = F.when(i % 11 == 0, F.lit("__tests__")).otherwise(F.col("lang"))
    listed = lambda cond, value: F.when(cond, F.array(value)).otherwise(F.array().cast("array<string>"))
    path = F.concat(F.lit("src/"), F.col("source"), F.lit("/"), folder, F.lit("/doc_"), i.cast("string"), F.when(i % 13 == 0, ".spec.md").otherwise(".md"))
    return rows.select(
        i.alias("file_id"),
        F.concat(F.lit("ws"), (i % 3).cast("string")).alias("workspace"),
        path.alias("file_path"),
        F.sha1(F.col("text")).alias("file_hash"),
        F.when(i % 17 != 0, F.col("source")).alias("cluster"),
        F.col("lang").alias("language"),
        F.size(F.split("text", "\n")).cast("long").alias("loc"),
        F.when(i % 5 != 0, F.element_at(F.split("text", "\n"), 1)).alias("blurb"),
        F.when(i % 7 == 0, F.lit("")).when(i % 7 != 3, F.col("text")).alias("purpose"),
        F.array_distinct(F.array(F.concat(F.lit("p"), (i % 7).cast("string")), F.concat(F.lit("p"), (i % 4).cast("string")))).alias("patterns"),
        F.when(i % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), (i % 5).cast("string")), F.col("lang"))).alias("tags"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"), F.concat(F.lit("h"), (i % 3).cast("string")))).otherwise(F.array().cast("array<string>")).alias("hazards"),
        F.when(i % 9 != 0, F.concat(F.lit("m"), (i % 2).cast("string"))).alias("extraction_model"),
        F.when(i % 8 != 0, F.array(F.struct(F.concat(F.lit("readDoc"), (i % 50).cast("string")).alias("name"), F.col("lang").alias("type")))).otherwise(F.array().cast("array<struct<name:string,type:string>>")).alias("exports"),
        F.when(i % 4 != 1, F.array(F.struct(F.lit("head").alias("label"), F.lit(1).alias("startLine"), F.lit(2).alias("endLine")))).otherwise(F.array().cast("array<struct<label:string,startLine:int,endLine:int>>")).alias("source_highlights"),
        F.when(i % 10 != 3, i % 6).alias("cross_references"),
        listed(i % 3 == 0, F.lit("named exports")).alias("conventions"),
        listed(i % 4 == 0, F.concat(F.lit("Doc"), (i % 50).cast("string"))).alias("key_types"),
        listed(i % 5 == 2, F.concat(F.lit("load "), F.regexp_extract("text", WORDS, 1), F.lit(" and derive `"), F.regexp_extract("text", WORDS, 2), F.lit("` from `"), F.regexp_extract("text", WORDS, 3), F.lit("`"))).alias("data_flows"),
        F.col("text"),
    )


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> part: each line of an order with an odd number, and the lines of the next number."""
    return _line_edges(spark, sf_dir, 1).select("source", "target").distinct()


def _line_edges(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    a = rows.where(n % 2 == odd).select("l_orderkey", (n + 1).alias("n"), F.col("l_partkey").alias("s"), "l_returnflag", "l_discount")
    b = rows.where(n % 2 != odd).select("l_orderkey", n.alias("n"), F.col("l_partkey").alias("t"))
    name = lambda c: F.concat(F.lit("part_"), F.lpad(F.col(c).cast("string"), 6, "0"))
    return a.join(b, ["l_orderkey", "n"]).where("s <> t").select(name("s").alias("source"), name("t").alias("target"), "l_returnflag", "l_discount")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, weighted edges part -> part: lines with an even number, and those of the next number."""
    rows = _line_edges(spark, sf_dir, 0)
    kind = F.when(F.col("l_returnflag") == "A", "runtime_call").when(F.col("l_returnflag") == "N", "type_ref").otherwise("CALLS")
    return rows.groupBy("source", "target", kind.alias("edge_type")).agg(F.count("*").alias("usage_count"), F.round(F.avg(1 - F.col("l_discount")), 6).alias("confidence"))


def main_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's main import: of its imports the one whose digest with it is least. One edge a node, so
    several cycles and long ways to them."""
    e = import_edges(spark, sf_dir)
    pick = F.min(F.struct(F.sha1(F.concat("source", "target")).alias("d"), "target")).alias("b")
    return e.groupBy("source").agg(pick).select("source", "b.target")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("symbol_id"),
        F.concat(F.lit("part_"), F.lpad(k.cast("string"), 6, "0")).alias("file_path"),
        F.col("p_name").alias("name"),
        F.element_at(F.split("p_type", " "), 1).alias("raw_kind"),
        (F.col("p_size") % 2 == 0).alias("exported"),
        F.col("p_size").cast("long").alias("line_start"),
    )


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per event."""
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        i.alias("id"),
        F.concat(F.lit("ws"), (u % 3).cast("string")).alias("workspace"),
        F.concat(F.lit("src/user_"), u.cast("string")).alias("file_path"),
        F.when(i % 19 != 0, F.col("event_type")).alias("cluster"),
        F.when(u % 4 != 0, F.concat(F.lit("author_"), (u % 17).cast("string"))).alias("author_name"),
        F.concat(F.lit("inst_"), (u % 23).cast("string")).alias("author_instance_id"),
        F.concat(F.lit("engine_"), (u % 3).cast("string")).alias("author_engine"),
        F.when(u % 5 != 0, F.concat(F.lit("model_"), (u % 6).cast("string"))).alias("author_model"),
        F.when(u % 2 == 0, "cli").alias("author_engine_type"),
        F.concat(F.col("event_type"), F.lit(" by user "), u.cast("string"), F.lit(" step "), (i % 40).cast("string")).alias("summary"),
        (F.col("event_type") == "error").alias("breaking_changes"),
        F.when(F.col("value") > 50, "verified").when(F.col("value") > 20, "pending").otherwise("disputed").alias("verification_status"),
        F.when(i % 3 != 0, F.sha1(i.cast("string"))).alias("commit_sha"),
        F.col("ts").alias("created_at"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a text: the turns of a conversation, numbered and dated by turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("file_path"),
        (F.lit(1000) * F.col("turn")).cast("long").alias("created_at"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html")


def _line_sql(odd: int) -> str:
    return f"""select 'part_' || lpad(a.l_partkey::varchar, 6, '0') as source, 'part_' || lpad(b.l_partkey::varchar, 6, '0') as target, a.l_returnflag, a.l_discount
  from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1
  where a.l_linenumber % 2 = {odd} and a.l_partkey <> b.l_partkey"""


SQL = {
    "files": r"""select d.doc_id as file_id, 'ws' || (d.doc_id % 3) as workspace,
  'src/' || d.source || '/' || case when d.doc_id % 11 = 0 then '__tests__' else d.lang end || '/doc_' || d.doc_id || case when d.doc_id % 13 = 0 then '.spec.md' else '.md' end as file_path,
  sha1(d.text) as file_hash, case when d.doc_id % 17 <> 0 then d.source end as cluster, d.lang as language, len(string_split(d.text, chr(10)))::bigint as loc,
  case when d.doc_id % 5 <> 0 then string_split(d.text, chr(10))[1] end as blurb, case when d.doc_id % 7 = 0 then '' when d.doc_id % 7 <> 3 then d.text end as purpose,
  case when d.doc_id % 7 = d.doc_id % 4 then ['p' || (d.doc_id % 7)] else ['p' || (d.doc_id % 7), 'p' || (d.doc_id % 4)] end as patterns,
  case when d.doc_id % 6 = 0 then []::varchar[] else ['t' || (d.doc_id % 5), d.lang] end as tags,
  case when l.toxic = 1 then ['toxic', 'h' || (d.doc_id % 3)] else []::varchar[] end as hazards,
  case when d.doc_id % 9 <> 0 then 'm' || (d.doc_id % 2) end as extraction_model,
  case when d.doc_id % 8 <> 0 then [{'name': 'readDoc' || (d.doc_id % 50), 'type': d.lang}] else []::struct(name varchar, type varchar)[] end as exports,
  case when d.doc_id % 4 <> 1 then [{'label': 'head', 'startLine': 1, 'endLine': 2}] else [] end as source_highlights, case when d.doc_id % 10 <> 3 then d.doc_id % 6 end as cross_references,
  case when d.doc_id % 3 = 0 then ['named exports'] else []::varchar[] end as conventions, case when d.doc_id % 4 = 0 then ['Doc' || (d.doc_id % 50)] else []::varchar[] end as key_types,
  case when d.doc_id % 5 = 2 then ['load ' || regexp_extract(d.text, '^\W*(\w+)\W+(\w+)\W+(\w+)', 1) || ' and derive `' || regexp_extract(d.text, '^\W*(\w+)\W+(\w+)\W+(\w+)', 2) || '` from `' || regexp_extract(d.text, '^\W*(\w+)\W+(\w+)\W+(\w+)', 3) || '`'] else []::varchar[] end as data_flows, d.text
  from documents d left join labels l on d.doc_id = l.doc_id""",
    "import_edges": f"select distinct source, target from ({_line_sql(1)})",
    "refs": f"""select source, target, case l_returnflag when 'A' then 'runtime_call' when 'N' then 'type_ref' else 'CALLS' end as edge_type, count(*)::bigint as usage_count, round(avg(1 - l_discount), 6) as confidence
  from ({_line_sql(0)}) group by all""",
    "main_edges": "select source, arg_min(target, sha1(source || target)) as target from import_edges group by source",
    "symbols": """select p_partkey as symbol_id, 'part_' || lpad(p_partkey::varchar, 6, '0') as file_path, p_name as name, string_split(p_type, ' ')[1] as raw_kind, p_size % 2 = 0 as exported, p_size::bigint as line_start from part""",
    "changelog": """select event_id as id, 'ws' || (user_id % 3) as workspace, 'src/user_' || user_id as file_path, case when event_id % 19 <> 0 then event_type end as cluster,
  case when user_id % 4 <> 0 then 'author_' || (user_id % 17) end as author_name, 'inst_' || (user_id % 23) as author_instance_id, 'engine_' || (user_id % 3) as author_engine,
  case when user_id % 5 <> 0 then 'model_' || (user_id % 6) end as author_model, case when user_id % 2 = 0 then 'cli' end as author_engine_type,
  event_type || ' by user ' || user_id || ' step ' || (event_id % 40) as summary, event_type = 'error' as breaking_changes,
  case when value > 50 then 'verified' when value > 20 then 'pending' else 'disputed' end as verification_status,
  case when event_id % 3 <> 0 then sha1(event_id::varchar) end as commit_sha, ts as created_at from events""",
    "snapshots": """select conv_id * 1000 + turn as id, 'conv_' || conv_id as file_path, (1000 * turn)::bigint as created_at, coalesce(text, '') as content, sha256(coalesce(text, '')) as content_hash from conversations""",
    "vectors": "select vec_id, embedding::double[] as v, label from embeddings",
    "all_edges": "select source, target, 'import' as edge_type, 1::bigint as usage_count, 1.0::double as confidence, 'parser' as provenance from import_edges union all select source, target, edge_type, usage_count, confidence, 'ast' from refs",
}
NEEDS = {"all_edges": ("import_edges", "refs"), "main_edges": ("import_edges",)}


def with_views(statement: str) -> str:
    """The statement with the views it names in front, as common table expressions."""
    found: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in found:
            found.append(name)

    for name in SQL:
        if re.search(rf"\b{name}\b", statement):
            add(name)
    if not found:
        return statement
    views = ",\n".join(f"{name} as ({SQL[name]})" for name in found)
    body = statement.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {views},\n{body[14:].strip()}"
    if body.lower().startswith("with"):
        return f"with {views},\n{body[4:].strip()}"
    return f"with {views}\n{body}"
