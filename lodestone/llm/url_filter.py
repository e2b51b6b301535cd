"""URL filters: rules by host and path, and a character language-model ratio where no rule fits.

Two smoothed Markov models of variable order are learned, of accepted and of rejected URLs. A URL is judged
by the difference of its log-likelihoods per character, against a threshold calibrated on labelled URLs that
the models have not seen. DataFrame functions only.

A context is as long as the counts bear (up to ORDER characters): P(c | h) interpolates the counts with the
next shorter context (Witten-Bell), and where c or h was not seen the shorter context decides. Along a URL
the logarithms telescope, so that its log-likelihood is a sum of one weight for each of its substrings of up
to ORDER + 1 characters. Both models become one table of weights, and a score is a join with it and a sum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, store

#: Longest context, in characters.
ORDER = 4
#: The bounds of a bounded fit: about so many different labelled URLs of each kind, chosen by hash, and so many grams
#: (substrings) in both models; those seen least often go first, all below a power of two at once. ``judge`` fits
#: without bounds. Weights are broadcast 2 * MAX_GRAMS short rows at a time.
FIT_URLS, MAX_GRAMS = 200_000, 200_000
#: What begins and ends a URL for the models, and how many characters an unseen one is one of.
BEGIN, END, ALPHABET = "\x02", "\x03", 65536
#: A URL is cut into pieces of so many characters, each read with the ORDER characters before it.
PIECE = 256
#: Thresholds are multiples of STEP (nats per character) within REACH.
STEP, REACH = 1 / 64, 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to
    ``?``, ``#`` or the end. Both are empty for null and where there is no ``://``."""
    host, path = (F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (``host/path`` -> allow or block) that fits, else nulls. A
    rule fits its host and all subdomains, if the path starts with the rule's; of equally long ones the
    least counts. Rules are a short list: each is a condition."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, rest = rule.partition("/")
        fits.append((rule, ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))))
    pick = lambda value: F.coalesce(*[F.when(fit, value(rule)) for rule, fit in fits], F.lit(None).cast("string"))
    return pick(F.lit), pick(lambda rule: F.lit(rules[rule]))


def grams(urls: DataFrame, url_col: str, *keep: str) -> DataFrame:
    """(*keep, gram): for each character of each URL, and its end, the substrings of 1 to ORDER + 1
    characters that end there. Pieces overlap, so that none is lost between them."""
    parts = F.regexp_extract_all(F.concat(url_col, F.lit(END)), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    begun = F.transform(parts, lambda p, k: F.concat(F.when(k == 0, BEGIN * ORDER).otherwise(F.right(F.get(parts, k - 1), F.lit(ORDER))), p))
    pieces = urls.select(*keep, F.explode(begun).alias("piece"))
    places = pieces.select(*keep, "piece", F.explode(F.sequence(F.lit(ORDER + 1), F.length("piece"))).alias("at"))
    ends = F.array(*[F.substring("piece", F.col("at") - n, F.lit(n + 1)) for n in range(ORDER + 1)])
    return places.select(*keep, F.explode(ends).alias("gram"))


@dataclass
class UrlModel:
    """``weights`` (gram, weight) of substrings; ``start`` and ``each`` are those of the beginning of a URL
    and of every character; a URL whose score is below ``threshold`` is blocked. Scores take ``passes`` over the
    URLs, each with a part of the weights. Without accepted or without rejected URLs there are no weights, all
    scores are 0 and everything is allowed."""

    weights: DataFrame | None
    start: float = 0.0
    each: float = 0.0
    threshold: float = 0.0
    passes: int = 1


def _weights(counts: DataFrame) -> UrlModel:
    """The model of (accepted, gram, n), which must hold all suffixes of its grams."""
    of = ["accepted", "context"]
    split = counts.withColumn("context", F.expr("left(gram, length(gram) - 1)"))
    contexts = split.groupBy(*of).agg(F.sum("n").alias("seen"), F.count("*").alias("kinds"))
    contexts = contexts.withColumn("back", F.log(F.col("kinds") / (F.col("seen") + F.col("kinds"))))
    known = split.join(contexts, of)
    ends = split.select("accepted", F.col("gram").alias("whole"), F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("size"), "gram")
    ends = ends.withColumn("gram", F.expr("right(gram, size)")).join(known, ["accepted", "gram"])
    chains = ends.groupBy("accepted", "whole").agg(F.sort_array(F.collect_list(F.struct("size", "n", "seen", "kinds", "back"))).alias("chain"))
    likely = lambda chain: F.aggregate(chain, F.lit(1 / ALPHABET), lambda p, x: (x["n"] + x["kinds"] * p) / (x["seen"] + x["kinds"]))
    weight = F.log(likely(F.col("chain"))) - F.log(likely(F.expr("slice(chain, 1, size(chain) - 1)"))) - F.element_at("chain", -1)["back"]
    sign = F.when(F.col("accepted"), 1.0).otherwise(-1.0)
    own = chains.select(F.col("whole").alias("gram"), (sign * weight).alias("weight"))
    back = contexts.select(F.col("context").alias("gram"), (sign * F.col("back")).alias("weight"))
    table = store(own.unionByName(back).groupBy("gram").agg(F.sum("weight").alias("weight")), "url_weights")
    starts = {BEGIN * k for k in range(ORDER + 1)}
    fixed = {r["gram"]: r["weight"] for r in table.where(F.col("gram").isin(*starts)).collect()}
    return UrlModel(table, sum(w for g, w in fixed.items() if g), fixed.get("", 0.0), passes=max(1, math.ceil(table.count() / (2 * MAX_GRAMS))))


def fit(labelled: DataFrame, url_col: str = "url", accepted_col: str = "accepted", bounded: bool = True) -> UrlModel:
    """A model of URLs labelled ``accepted`` (true or false; rows with a null in either column are not used).

    Each different URL counts once; one with both labels counts for both. Three quarters of them, by hash,
    make the models, the others the threshold: the multiple of STEP with the least sum of the shares of
    accepted URLs blocked and rejected ones allowed, of equal ones the nearest to 0. Where the fit is not
    ``bounded``, all of them and all grams seen twice count.
    """
    different = labelled.select(F.col(url_col).alias("url"), F.col(accepted_col).alias("accepted")).where("url is not null and accepted is not null").distinct()
    different = store(different.withColumn("draw", F.md5(F.col("url").cast("binary"))), "url_labels")
    numbers = {r["accepted"]: r["n"] for r in different.groupBy("accepted").agg(F.count("*").alias("n")).collect()}
    share = lambda kind: min(1.0, FIT_URLS / max(numbers.get(kind, 0), 1)) if bounded else 1.0
    drawn = F.conv(F.substring("draw", 2, 6), 16, 10).cast("long") / F.lit(float(16**6))
    chosen = different.where(drawn < F.when(F.col("accepted"), share(True)).otherwise(share(False)))
    held = F.substring("draw", 1, 1) < "4"
    counts = store(grams(chosen.where(~held), "url", "accepted").groupBy("accepted", "gram").agg(F.count("*").alias("n")), "url_grams")
    sizes = {r["e"]: (r["grams"], r["kinds"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("e")).agg(F.count("*").alias("grams"), F.collect_set("accepted").alias("kinds")).collect()}
    if len({kind for _, kinds in sizes.values() for kind in kinds}) < 2:
        drop(different, counts)
        return UrlModel(None)
    least = next(e for e in range(1, 65) if not bounded or sum(n for k, (n, _) in sizes.items() if k >= e) <= MAX_GRAMS)
    model = _weights(counts.where(F.col("n") >= 1 << least))
    # the threshold: a table of as many rows as there are steps
    bins = score(chosen.where(held).select(F.struct("url", "accepted").alias("key"), "url"), model, "key", "url")
    place = F.least(F.greatest(F.floor(F.col("score") / STEP), F.lit(-int(REACH / STEP))), F.lit(int(REACH / STEP)))
    table = {(r["place"], r["accepted"]): r["n"] for r in bins.groupBy(place.alias("place"), F.col("key.accepted").alias("accepted")).agg(F.count("*").alias("n")).collect()}
    whole = {kind: sum(n for (_, k), n in table.items() if k == kind) for kind in (True, False)}
    if all(whole.values()):
        wrong = lambda b: sum(n / whole[kind] for (p, kind), n in table.items() if (p < b) == kind)
        places = sorted({p + d for p, _ in table for d in (0, 1)} | {0}, key=lambda b: (abs(b), b))
        model.threshold = min(places, key=lambda b: round(wrong(b), 12)) * STEP
    drop(different, counts)
    return model


def score(rows: DataFrame, model: UrlModel, id_col: str, url_col: str) -> DataFrame:
    """(id_col, url_col, score): the difference of log-likelihoods, accepted minus rejected, per character and
    end. Null URLs score as empty ones. Rows that repeat both id and URL are scored once and come out as
    often as they came; nothing is grouped by URL alone, so that a frequent one is dealt evenly."""
    base = rows.groupBy(F.col(id_col).alias("id"), F.col(url_col).alias("url")).agg(F.count("*").alias("times")).withColumn("text", F.coalesce("url", F.lit("")))
    if model.weights is None:
        scored = base.withColumn("score", F.lit(0.0))
    else:
        of = ["id", "url", "times", "text"]

        def part(k: int) -> DataFrame:
            some = model.weights.where(F.pmod(F.xxhash64("gram"), F.lit(model.passes)) == k) if model.passes > 1 else model.weights
            return grams(base, "text", *of).join(F.broadcast(some), "gram", "left").groupBy(*of).agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("sum"))

        summed = reduce(DataFrame.unionByName, map(part, range(model.passes)))
        if model.passes > 1:
            summed = summed.groupBy(*of).agg(F.sum("sum").alias("sum"))
        length = F.length("text") + 1
        scored = summed.withColumn("score", (F.col("sum") + F.lit(model.start) + length * F.lit(model.each)) / length)
    again = F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))
    return scored.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "score", again.alias("again")).drop("again")


def judge(rows: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row: id_col, host, path, rule, verdict, score.

    Where a rule fits, it decides and score is null. All others are judged by a model that is fitted on the
    URLs that rules decide. Null URLs are empty; repeated rows stay; other columns are not read; an empty
    table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col))
    base = rows.select(id_col, url_col).withColumn("host", host).withColumn("path", path)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = base.withColumn("rule", rule).withColumn("verdict", verdict)
    told = ruled.where("rule is not null")
    model = fit(told.select(F.col(url_col).alias("url"), (F.col("verdict") == "allow").alias("accepted")), bounded=False)
    rest = score(ruled.where("rule is null").select(id_col, url_col), model, id_col, url_col)
    rest = rest.withColumn("verdict", F.when(F.col("score") >= model.threshold, "allow").otherwise("block"))
    rest = rest.select(id_col, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), "verdict", "score")
    return told.select(id_col, "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score")).unionByName(rest)


#: Fixed values of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by rule, and by the models where none fits."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES).drop("score")


def _spelled(source: str) -> str:
    return f"""select *, substring(t, spot - k, k + 1) as gram from (
    select *, unnest(range({ORDER + 1}, length(t) + 1)) as spot from (select *, repeat(chr(2), {ORDER}) || url || chr(3) as t from {source})), range({ORDER + 1}) r(k)"""


def _scored(source: str, key: str) -> str:
    """Per key: the longest known gram of each place decides, after the fallbacks of longer known contexts."""
    return f"""
  select {key}, sum(case kind when true then s else -s end) / any_value(length(url) + 1) as score from (
    select {key}, any_value(url) as url, kind, spot,
           coalesce(arg_max(ln(p), k) filter (p is not null), ln(1 / {ALPHABET}.0)) + coalesce(sum(back) filter (p is null), 0) as s
    from (select s.*, c.kind, g.p, b.back from ({_spelled(source)}) s cross join (values (true), (false)) c(kind)
          left join likely g on g.accepted = c.kind and g.gram = s.gram
          left join contexts b on b.accepted = c.kind and b.context = left(s.gram, length(s.gram) - 1))
    group by {key}, kind, spot) group by {key}"""


OP11_SQL = f"""
with recursive split as (
  select page_id, coalesce(url, '') as url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path
  from pages),
ruled as (
  select row_number() over () as row, *,
         case when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
              when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
              when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
              when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule
  from split),
labelled as (select distinct url, rule in ('example.net/en/', 'org/fr/') as accepted, md5(url)[1] < '4' as held from ruled where rule is not null),
fitted as (select url, accepted from labelled where not held),
counts as materialized (select accepted, gram, count(*) as n, left(gram, length(gram) - 1) as context from ({_spelled("fitted")}) group by all having count(*) >= 2),
contexts as materialized (select accepted, context, sum(n) as seen, count(*) as kinds, ln(count(*) / (sum(n) + count(*))) as back from counts group by all),
stats as materialized (select * from counts join contexts using (accepted, context)),
chain(accepted, gram, m, p) as (
  select accepted, gram, 0, 1 / {ALPHABET}.0::double from counts
  union all
  select c.accepted, c.gram, m + 1, (s.n + s.kinds * c.p) / (s.seen + s.kinds)
  from chain c join stats s on s.accepted = c.accepted and s.gram = right(c.gram, m + 1) where m < length(c.gram)),
likely as materialized (select accepted, gram, p from chain where m = length(gram)),
enough as (select count(distinct accepted) = 2 as yes from fitted),
tried as materialized (select accepted, greatest(least(floor(score / {STEP}), {int(REACH / STEP)}), {-int(REACH / STEP)}) as place
  from ({_scored("(select url, accepted from labelled where held)", "url, accepted")})),
steps as (
  select b, round(avg(case when accepted then (place < b)::int end), 12) + round(avg(case when not accepted then (place >= b)::int end), 12) as wrong
  from range({-int(REACH / STEP)}, {int(REACH / STEP) + 2}) r(b), tried group by b),
best as (select coalesce((select b from steps where wrong is not null order by round(wrong, 11), abs(b), b limit 1), 0) * {STEP} as threshold),
scores as ({_scored("(select row, url from ruled where rule is null)", "row")})
select page_id, host, path, rule,
       case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
            when not (select yes from enough) or score >= (select threshold from best) then 'allow' else 'block' end as verdict
from ruled left join scores using (row)
"""
