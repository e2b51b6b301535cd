"""Registered queries: scalar functions by category, and the joins that audits are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import quality
from ..functions.text import token_set
from ..operators.retrieval import similar
from ..shared import cut
from ..sources.adapters import changelog, files, import_edges, references, table, with_views
from .graphs import aud_exported_not_referenced, aud_loaded_not_used, metrics
from .registry import ORACLES, query


def sql(key, statement):
    return query(key, with_views(statement))


query("jn_loaded_not_used", ORACLES["aud_loaded_not_used"])(aud_loaded_not_used)
query("jn_exports_unused", ORACLES["aud_exported_not_referenced"])(aud_exported_not_referenced)


@sql("jn_imported_unused", "select i.source, i.target from import_edges i left join refs r on r.source = i.source and r.target = i.target where r.source is null")
def jn_imported_unused(spark, sf_dir):
    """Imports that no reference between the two files follows."""
    return import_edges(spark, sf_dir).join(references(spark, sf_dir).select("source", "target"), ["source", "target"], "left_anti")


@query("topk_hotspots", ORACLES["aud_hotspots"].replace("limit 20", "limit 5"))
def topk_hotspots(spark, sf_dir):
    """The top of a full order, kept by each task and merged."""
    score = 3 * F.col("changes") + 2 * F.col("degree") + F.log2(F.greatest(F.lit(1), F.col("loc")))
    return metrics(spark, sf_dir).select("file_path", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "file_path").limit(5)


@sql("fn_string", r"select p_partkey, lower(regexp_replace(p_name, '\s+', '-', 'g')) as kebab, regexp_matches(p_name, '\b' || split_part(p_name, ' ', 1) || '\b') as word, upper(substr(trim(p_name), 1, 3)) as head from part")
def fn_string(spark, sf_dir):
    first = F.element_at(F.split("p_name", " "), 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.regexp_replace("p_name", r"\s+", "-")).alias("kebab"), F.rlike(F.col("p_name"), F.concat(F.lit(r"\b"), first, F.lit(r"\b"))).alias("word"), F.upper(F.substring(F.trim("p_name"), 1, 3)).alias("head"))


@sql("fn_path", "select file_id, string_split(file_path, '/')[-1] as base, regexp_replace(file_path, '/[^/]*$', '') as folder, '.md' as ext from files")
def fn_path(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", F.element_at(F.split("file_path", "/"), -1).alias("base"), F.regexp_replace("file_path", "/[^/]*$", "").alias("folder"), M.extension(F.col("file_path")).alias("ext"))


@sql("fn_hash", "select file_id, sha1(file_path) as s1, sha256(file_path) as s2, md5(file_path) as m from files")
def fn_hash(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", F.sha1("file_path").alias("s1"), F.sha2("file_path", 256).alias("s2"), F.md5("file_path").alias("m"))


@sql("fn_datetime", "select id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') as iso, date_diff('day', created_at::date, date '2024-02-01')::int as age, date_trunc('hour', created_at) as hour from changelog")
def fn_datetime(spark, sf_dir):
    c = changelog(spark, sf_dir)
    return c.select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("created_at")).alias("age"), F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour"))


@sql("fn_math", "select l_orderkey, l_linenumber, round(log2(l_quantity), 6) as a, round(ln(1 + l_discount), 6) as b, floor(l_extendedprice)::bigint as c, greatest(0, least(1, l_tax * 20)) as d from lineitem")
def fn_math(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", F.round(F.log2("l_quantity"), 6).alias("a"), F.round(F.log1p("l_discount"), 6).alias("b"), F.floor("l_extendedprice").alias("c"), F.greatest(F.lit(0), F.least(F.lit(1), F.col("l_tax") * 20)).alias("d"))


@sql("fn_array", "select file_id, len(list_distinct(list_concat(tags, patterns)))::int as both, list_contains(tags, 't1') as has, array_to_string(list_filter(patterns, lambda p: p <> 'p0'), ',') as rest from files")
def fn_array(spark, sf_dir):
    return files(spark, sf_dir).select("file_id", F.size(F.array_union("tags", "patterns")).alias("both"), F.array_contains("tags", "t1").alias("has"), F.array_join(F.filter("patterns", lambda p: p != "p0"), ",").alias("rest"))


@sql("fn_json", "select event_id, json_extract(props, '$.k')::bigint as k, json_valid(props) as valid from events")
def fn_json(spark, sf_dir):
    """Nested values by path; what can't be parsed is null, not an error."""
    parsed = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(parsed, "$.k", "bigint").alias("k"), parsed.isNotNull().alias("valid"))


@sql("fn_set_similarity", "with s as (select p_partkey, p_brand, list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9_]+'), lambda t: len(t) > 1)) as t from part) select a.p_partkey as a, b.p_partkey as b, round(len(list_intersect(a.t, b.t))::double / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) as score from s a join s b on a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey and a.p_partkey % 20 = 0 where len(list_intersect(a.t, b.t))::double / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.5")
def fn_set_similarity(spark, sf_dir):
    """A query set against all rows of its brand. Rows of one brand and set are a class: classes are compared, and
    the pairs of their members told."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.array_sort(token_set(F.col("p_name"), F.col("p_type"))).alias("t"))
    classes = cut(rows.groupBy("p_brand", "t").agg(F.max(F.col("p_partkey") % 20 == 0).alias("asks")).withColumn("class", F.monotonically_increasing_id()))
    members = cut(rows.join(classes.select("p_brand", "t", "class"), ["p_brand", "t"]).select("p_partkey", "class"))
    a = classes.where("asks").select("p_brand", F.col("class").alias("ca"), F.col("t").alias("ta"))
    b = classes.select("p_brand", F.col("class").alias("cb"), F.col("t").alias("tb"))
    alike = cut(similar(a, b, "p_brand", "ta", "tb", 0.5).select("ca", "cb", F.round("score", 6).alias("score")))
    asking = members.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("a"), F.col("class").alias("ca"))
    told = asking.join(alike, "ca").join(members.select(F.col("p_partkey").alias("b"), F.col("class").alias("cb")).hint("merge"), "cb")
    return told.where("a <> b").select("a", "b", "score")


@sql("fn_hygiene", r"select p_partkey, trim(regexp_replace(regexp_replace('<b>' || p_name || '</b> `' || p_type || '`', '<[^>]*>|[`*#]+', ' ', 'g'), '\s+', ' ', 'g')) as pattern from part")
def fn_hygiene(spark, sf_dir):
    raw = F.concat(F.lit("<b>"), "p_name", F.lit("</b> `"), "p_type", F.lit("`"))
    return table(spark, sf_dir, "part").select("p_partkey", quality.clean_pattern(raw).alias("pattern"))


@sql("fn_authority", "select file_id, case when file_id % 4 = 0 then case when file_id % 8 = 0 then 'changelog' else 'index' end when file_id % 4 = 1 then 'source' else 'index' end as authority from files")
def fn_authority(spark, sf_dir):
    """Which evidence decides about a file."""
    i = F.col("file_id")
    source = F.when(i % 4 == 1, F.sha1(F.lit("other"))).when(i % 4 != 0, F.col("file_hash"))
    return files(spark, sf_dir).select("file_id", quality.authority(source, F.col("file_hash"), i % 8 == 0).alias("authority"))


@sql("fn_dedupe_hazards", "select p_brand, count(distinct lower(p_type))::bigint as kept from part group by p_brand")
def fn_dedupe_hazards(spark, sf_dir):
    """First-wins deduplication is order-dependent: a kernel per group of bounded lists."""
    lists = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set(F.lower("p_type"))).alias("h"))

    def run(parts):
        for part in parts:
            yield part.assign(kept=[len(quality.dedupe_hazards(list(h))) for h in part.pop("h")])

    return lists.mapInPandas(run, "p_brand string, kept bigint")
