"""Registered queries: full text, vectors, fusion, similarity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, normalize, prepared, query_terms, token_set, tokens
from ..operators import retrieval as R
from ..operators.ngrams import GramIndex
from ..operators.positional import WORD, PositionalIndex
from ..operators.search_index import SearchIndex
from ..shared import cut, new_folder
from ..sources.adapters import changelog, files, table, vectors, with_views
from .registry import query

QUERY = "thation of the anHeron_ther erblest"
TERMS = query_terms(QUERY)
CHANGES = "purchase step error"
CHANGE_TERMS = query_terms(CHANGES)
TEST_PATH = r"(?i)(^|/)(__tests__|test|tests|fixtures)(/|$)|\.(test|spec)\.[^.]+$"
TEST_SQL = r"regexp_matches(file_path, '(?i)(^|/)(__tests__|test|tests|fixtures)(/|$)|\.(test|spec)\.[^.]+$')"
FOLD = r"list_filter(string_split_regex(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def bm25_sql(source: str, key: str, text: str, terms: list[str], name: str = "scored") -> str:
    """CTEs that end in ``name`` (key, score)."""
    listed = ", ".join(f"('{t}')" for t in dict.fromkeys(terms))
    return f"""{name}_tok as (select {key} as doc, unnest({FOLD.format(text)}) as term from {source}),
{name}_len as (select {key} as doc, len({FOLD.format(text)}) as dl from {source}),
{name}_n as (select count(*) as n, avg(dl) as avgdl from {name}_len),
{name}_tf as (select doc, term, count(*) as tf from {name}_tok where term in (select * from (values {listed})) group by all),
{name}_df as (select term, count(*) as df from {name}_tf group by term),
{name} as (select t.doc, -sum((case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score
  from {name}_tf t join {name}_df using (term) join {name}_len using (doc) cross join {name}_n group by t.doc)"""


def document():
    """The searchable text of a file: eight columns, lists as JSON, all normalised."""
    listed = lambda c: F.to_json(F.array_sort(c))
    return normalize(F.concat_ws(" ", "file_path", "cluster", "purpose", "blurb", listed("patterns"), listed("tags"), listed("hazards"), F.to_json("exports")))


NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_-]+', ' ', 'g'), '\s+', ' ', 'g'))"
LISTED = "'[' || array_to_string(list_transform(list_sort({0}), lambda x: '\"' || x || '\"'), ',') || ']'"
EXPORTS = """case when len(exports) = 0 then '[]' else '[{"name":"' || exports[1].name || '","type":"' || exports[1].type || '"}]' end"""
DOCUMENT = NORMAL.format(f"concat_ws(' ', file_path, cluster, purpose, blurb, {LISTED.format('patterns')}, {LISTED.format('tags')}, {LISTED.format('hazards')}, {EXPORTS})")
DOCUMENTS = f"docs as (select file_id, {DOCUMENT} as document from files)"

_stored: dict[tuple[str, str], tuple[str, object]] = {}


def _version(spark, sf_dir, *names) -> str:
    """What tells one state of tables from another: their files' names, sizes and times."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(sf_dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [fs.getFileStatus(path(f"{sf_dir}/{n}.parquet")) for n in names]
    found += [f for at in found if at.isDirectory() for f in fs.listStatus(at.getPath())]
    return ";".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in found))


def stored(spark, name, sf_dir, tables, make):
    """What ``make`` made of ``tables`` in this session; where they have changed since, what it makes of
    that and of them."""
    key = spark.sparkContext.applicationId, f"{sf_dir}#{name}"
    version = _version(spark, sf_dir, *tables)
    known, value = _stored.get(key, (None, None))
    if known != version:
        value = make(value)
        _stored[key] = version, value
    return value


def _index(spark, name, docs, id_col, text):
    """Builds an index, or refreshes it document by document."""

    def make(index):
        index = index or SearchIndex(spark, new_folder(spark, f"{name}-index"))
        index.refresh(docs(), id_col, text)
        return index

    return make


def documents(spark, sf_dir):
    return files(spark, sf_dir).withColumn("document", document())


def file_index(spark, sf_dir) -> SearchIndex:
    """The stored index over the files' documents."""
    return stored(spark, "files", sf_dir, ("documents", "labels"), _index(spark, "files", lambda: documents(spark, sf_dir), "file_id", F.col("document")))


#: The columns of a substring search, kept apart by a character that no query holds.
APART = "\x1f"
SOUGHT = r"lower(concat_ws(chr(31), file_path, blurb, purpose, array_to_string(tags, ' '), array_to_string(patterns, ' '), array_to_string(hazards, ' ')))"


def gram_index(spark, sf_dir) -> GramIndex:
    """The stored n-gram index over the columns of files."""
    listed = lambda c: F.array_join(c, " ")
    text = F.lower(F.concat_ws(APART, "file_path", "blurb", "purpose", listed("tags"), listed("patterns"), listed("hazards")))
    return stored(spark, "grams", sf_dir, ("documents", "labels"), lambda old: GramIndex.build(files(spark, sf_dir), "file_id", text))


def change_index(spark, sf_dir) -> SearchIndex:
    return stored(spark, "changes", sf_dir, ("events",), _index(spark, "changes", lambda: changelog(spark, sf_dir), "id", F.col("summary")))


def file_scores(spark, sf_dir):
    return files(spark, sf_dir), file_index(spark, sf_dir).search(TERMS)


def change_scores(spark, sf_dir):
    return change_index(spark, sf_dir).search(CHANGE_TERMS)


FILE_SCORES = DOCUMENTS + ",\n" + bm25_sql("docs", "file_id", "document", TERMS)
#: Characters of a page of results as JSON.
BUDGET = 2500


@query("act_search", with_views(f"""with {FILE_SCORES},
hits as (select f.file_id, f.workspace, f.file_path, f.cluster, s.score from scored s join files f on f.file_id = s.doc where f.workspace = 'ws1' and not {TEST_SQL} and starts_with(f.file_path, 'src/')),
ranked as (select *, row_number() over (order by round(score, 9), file_path) as rank from hits qualify rank <= 50),
sized as (select *, sum(length('{{"file_path":"' || file_path || '"' || coalesce(',"cluster":"' || cluster || '"', '') || '}}') + 1) over (order by rank) + 1 as used from ranked)
select file_id, file_path, cluster, round(score, 6) as score, rank::int as rank from sized where used <= {BUDGET}"""))
def act_search(spark, sf_dir):
    """Ranked search in one workspace over the stored index: filters before the cut, so that recall is
    whole; one row a path; then the page, and of it what the character budget holds."""
    f, scores = file_scores(spark, sf_dir)
    hits = f.where((F.col("workspace") == "ws1") & ~F.col("file_path").rlike(TEST_PATH) & F.col("file_path").startswith("src/"))
    hits = hits.select("file_id", "file_path", "cluster").join(scores, F.col("file_id") == F.col("doc"))
    hits = hits.groupBy("file_path").agg(F.min(F.struct("score", "file_id", "cluster")).alias("b")).select("file_path", "b.*")
    top = R.with_rank(hits.orderBy(F.round("score", 9), "file_path").limit(50), F.round("score", 9), "file_path")
    used = F.sum(F.char_length(F.to_json(F.struct("file_path", "cluster"))) + 1).over(Window.orderBy("rank")) + 1  # over one page
    return top.withColumn("used", used).where(F.col("used") <= BUDGET).select("file_id", "file_path", "cluster", F.round("score", 6).alias("score"), "rank")


@query("act_search_parity", with_views(f"""with {FILE_SCORES},
cut as (select f.file_id, f.file_path, s.score, row_number() over (order by round(score, 9), file_path) as rank from scored s join files f on f.file_id = s.doc where f.workspace = 'ws1')
select file_id, round(score, 6) as score, rank::int as rank from cut where rank <= 100 and not {TEST_SQL}"""))
def act_search_parity(spark, sf_dir):
    """The same with the cut before the filters: ranks are of the unfiltered list."""
    f, scores = file_scores(spark, sf_dir)
    hits = f.where("workspace = 'ws1'").select("file_id", "file_path").join(scores, F.col("file_id") == F.col("doc"))
    top = R.with_rank(hits.orderBy(F.round("score", 9), "file_path").limit(100), F.round("score", 9), "file_path")
    return top.where(~F.col("file_path").rlike(TEST_PATH)).select("file_id", F.round("score", 6).alias("score"), "rank")


@query("fts_search", with_views(f"with {FILE_SCORES} select doc as file_id, round(score, 6) as score from scored"))
def fts_search(spark, sf_dir):
    """Scores of every match in the store."""
    return file_scores(spark, sf_dir)[1].select(F.col("doc").alias("file_id"), F.round("score", 6).alias("score"))


@query("fts_build", with_views(f"with {DOCUMENTS}, t as (select file_id as doc, {FOLD.format('document')} as t from docs) select doc, len(t)::int as dl, term, count(*)::bigint as tf from (select doc, t, unnest(t) as term from t) group by all"))
def fts_build(spark, sf_dir):
    """The inverted index as it is stored."""
    index = SearchIndex(spark, new_folder(spark, "built-index"))
    index.upsert(documents(spark, sf_dir), "file_id", F.col("document"))
    return index.postings().select("doc", "dl", "term", "tf")


CHANGED = f"""docs as (select file_id, {DOCUMENT} as document from files),
changed as (select file_id, case when file_id % 5 = 0 then document || ' the erblest erblest heron' else document end as document from docs where file_id % 7 <> 0
  union all select file_id + 1000000, document from docs where file_id % 10 = 3)"""


@query("fts_maintain", with_views(f"""with {CHANGED},
{bm25_sql("changed", "file_id", "document", TERMS)} select doc as file_id, round(score, 6) as score from scored"""))
def fts_maintain(spark, sf_dir):
    """Scores of an index that was written before, and then lost a seventh of its documents, got new texts for a
    fifth and new documents besides: those of an index built anew over what is there now."""
    index = SearchIndex(spark, new_folder(spark, "maintained-index"))
    docs = documents(spark, sf_dir).select("file_id", "document")
    index.upsert(docs, "file_id", F.col("document"))
    index.delete(docs.where("file_id % 7 = 0").select(F.col("file_id").alias("key")))
    edited = docs.where("file_id % 5 = 0 and file_id % 7 <> 0").withColumn("document", F.concat("document", F.lit(" the erblest erblest heron")))
    added = docs.where("file_id % 10 = 3").withColumn("file_id", F.col("file_id") + 1000000)
    index.upsert(edited.unionByName(added), "file_id", F.col("document"))
    return index.search(TERMS).select(F.col("doc").alias("file_id"), F.round("score", 6).alias("score"))


@query("fts_rebuild", with_views(f"""with {DOCUMENTS} select term, count(distinct file_id)::bigint as df, count(*)::bigint as total from (select file_id, unnest({FOLD.format('document')}) as term from docs) group by term"""))
def fts_rebuild(spark, sf_dir):
    """Document and collection frequencies, as a rebuild derives them from the postings."""
    return file_index(spark, sf_dir).postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@query("fts_normalize", r"""select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name || 'HTTPServer' || p_brand || '_x-y', '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_-]+', ' ', 'g'), '\s+', ' ', 'g')) as text from part""")
def fts_normalize(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", normalize(F.concat("p_name", F.lit("HTTPServer"), "p_brand", F.lit("_x-y"))).alias("text"))


RAW_WORDS = "list_filter(string_split_regex(lower(regexp_replace(" + NORMAL.format("{0}") + r", '[?!@#$%^&*(){{}}\[\]<>:;\x22\x27`,.|\\~/+=]', ' ', 'g')), '\s+'), lambda t: len(t) > 1 and t not in ({1}))"


@query("fts_prepare", "with q as (select p_partkey, p_name || ' OF the ' || p_brand || ', getHTTP_x? ' || p_type as raw from part) select p_partkey, array_to_string(" + RAW_WORDS.format("raw", ", ".join(f"'{w}'" for w in sorted(STOPWORDS))) + ", ' OR ') as searched from q")
def fts_prepare(spark, sf_dir):
    """The terms that raw queries are searched by, as a column."""
    raw = F.concat("p_name", F.lit(" OF the "), "p_brand", F.lit(", getHTTP_x? "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(prepared(raw), " OR ").alias("searched"))


@query("fts_document", with_views(f"with {DOCUMENTS} select file_id, sha256(document) as document from docs"))
def fts_document(spark, sf_dir):
    """The searchable text of a file, one per row (as a digest: the texts are long)."""
    return files(spark, sf_dir).select("file_id", F.sha2(document(), 256).alias("document"))


@query("fts_search_changelog", with_views(f"""with {bm25_sql('changelog', 'id', 'summary', CHANGE_TERMS)}
select id, round(score, 6) as score from scored join changelog on id = doc where workspace = 'ws1' order by round(score, 9), created_at desc, id desc limit 100"""))
def fts_search_changelog(spark, sf_dir):
    c = changelog(spark, sf_dir)
    scores = change_scores(spark, sf_dir)
    hits = c.where("workspace = 'ws1'").select("id", "created_at").join(scores, F.col("id") == F.col("doc"))
    return hits.orderBy(F.round("score", 9), F.desc("created_at"), F.desc("id")).limit(100).select("id", F.round("score", 6).alias("score"))


NEAR = "select b.vec_id as id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2))) as distance from vectors a join vectors b on a.vec_id = 20 order by distance, id limit 20"
#: The stated query set of the vector searches: every vector whose id is divisible by 20, against all.
NEAR_ALL = """near as (select a.vec_id as query, b.vec_id as id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2))) as distance
  from vectors a join vectors b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id {0} qualify row_number() over (partition by a.vec_id order by distance, b.vec_id) <= 20)"""


def asked(v):
    return v.where("vec_id % 20 = 0")


@query("vec_search", with_views(f"with {NEAR_ALL.format('')} select query, id, round(distance, 6) as distance from near"))
def vec_search(spark, sf_dir):
    """The 20 nearest of each query vector."""
    v = vectors(spark, sf_dir)
    return R.nearest_all(v, asked(v), "vec_id", "v", 20).select("query", "id", F.round("value", 6).alias("distance"))


@query("vec_search_filtered", with_views(f"with {NEAR_ALL.format('and a.label = b.label')} select query, id, round(distance, 6) as distance from near"))
def vec_search_filtered(spark, sf_dir):
    """Nearest of the query's own kind."""
    v = vectors(spark, sf_dir)
    return R.nearest_all(v, asked(v), "vec_id", "v", 20, key="label").select("query", "id", F.round("value", 6).alias("distance"))


@query("jn_vec", with_views(f"with {NEAR_ALL.format('')} select n.query, f.file_path, round(n.distance, 6) as distance from near n join files f on f.file_id = n.id"))
def jn_vec(spark, sf_dir):
    v = vectors(spark, sf_dir)
    near = R.nearest_all(v, asked(v), "vec_id", "v", 20)
    return near.join(files(spark, sf_dir), F.col("file_id") == F.col("id")).select("query", "file_path", F.round("value", 6).alias("distance"))


@query("vec_cosine_best", "with v as (select vec_id, embedding::double[] as e, label from embeddings), p as (select a.vec_id, list_cosine_similarity(a.e, b.e) as c from v a join v b on a.label = b.label and a.vec_id % 20 = 0 and a.vec_id <> b.vec_id) select vec_id, round(max(c), 6) as best from p group by vec_id")
def vec_cosine_best(spark, sf_dir):
    """The best cosine within the label for the query vectors."""
    v = vectors(spark, sf_dir)
    return R.nearest_all(v, asked(v), "vec_id", "v", 1, "cosine", "label").select(F.col("query").alias("vec_id"), F.round("value", 6).alias("best"))


def two_lists(spark, sf_dir, depth=30):
    f, scores = file_scores(spark, sf_dir)
    lexical = R.with_rank(scores.orderBy(F.round("score", 9), "doc").limit(depth), F.round("score", 9), "doc").select(F.col("doc").alias("id"), "rank")
    v = vectors(spark, sf_dir)
    near = R.nearest(v, "vec_id", "v", v.where("vec_id = 20").select(F.col("v").alias("q")), depth)
    return lexical, R.with_rank(near, "distance", "id").select("id", "rank")


TWO = f"""{FILE_SCORES},
lexical as (select doc as id, row_number() over (order by round(score, 9), doc) as rank from scored qualify rank <= 30),
dense as (select id, row_number() over (order by distance, id) as rank from ({NEAR.replace('limit 20', 'limit 30')}))"""


@query("rrf_fuse", with_views(f"with {TWO}, s as (select id, sum(1 / (60.0::double + rank)) as score from (select * from lexical union all select * from dense) group by id) select id, round(score / max(score) over (), 6) as score from s"))
def rrf_fuse(spark, sf_dir):
    return R.rrf(list(two_lists(spark, sf_dir)), normalise=True).select("id", F.round("score", 6).alias("score"))


@query("rrf_fuse_files", with_views(f"with {TWO}, s as (select id, sum(1 / (60.0::double + rank)) as score from (select * from lexical union all select * from dense) group by id) select f.file_path, round(score, 6) as score from s join files f on f.file_id = s.id order by round(score, 9) desc, f.file_path limit 25"))
def rrf_fuse_files(spark, sf_dir):
    fused = R.rrf(list(two_lists(spark, sf_dir)))
    named = fused.join(files(spark, sf_dir), F.col("file_id") == F.col("id"))
    return named.orderBy(F.desc(F.round("score", 9)), "file_path").limit(25).select("file_path", F.round("score", 6).alias("score"))


@query("rrf_fuse_changelog", with_views(f"""with {bm25_sql('changelog', 'id', 'summary', CHANGE_TERMS)},
a as (select doc as id, row_number() over (order by round(score, 9), doc) as rank from scored qualify rank <= 40),
b as (select id, row_number() over (order by created_at desc, id desc) as rank from changelog qualify rank <= 40)
select id, round(sum(1 / (60.0::double + rank)), 6) as score from (select * from a union all select * from b) group by id"""))
def rrf_fuse_changelog(spark, sf_dir):
    """Relevance fused with recency."""
    c = changelog(spark, sf_dir)
    scores = change_scores(spark, sf_dir).orderBy(F.round("score", 9), "doc").limit(40)
    a = R.with_rank(scores, F.round("score", 9), "doc").select(F.col("doc").alias("id"), "rank")
    newest = c.select("id", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(40)
    b = R.with_rank(newest, F.desc("created_at"), F.desc("id")).select("id", "rank")
    return R.rrf([a, b]).select("id", F.round("score", 6).alias("score"))


@query("rrf_cross_workspace", with_views(f"""with {FILE_SCORES},
local as (select f.workspace, f.file_id, row_number() over (partition by f.workspace order by round(s.score, 9), f.file_path) as rank from scored s join files f on f.file_id = s.doc)
select file_id, workspace, round(1 / (60.0::double + rank), 6) as score from local where rank <= 20"""))
def rrf_cross_workspace(spark, sf_dir):
    """The best of each workspace, fused by rank alone."""
    f, scores = file_scores(spark, sf_dir)
    hits = f.select("file_id", "workspace", "file_path").join(scores, F.col("file_id") == F.col("doc"))
    local = hits.withColumn("rank", F.row_number().over(Window.partitionBy("workspace").orderBy(F.round("score", 9), "file_path"))).where("rank <= 20")
    return local.select("file_id", "workspace", F.round(1 / (F.lit(60.0) + F.col("rank")), 6).alias("score"))


@query("rerank_dense", with_views(f"with {TWO} select l.id, round(1 / (60.0::double + l.rank) + coalesce(1 / (60.0::double + d.rank), 0), 6) as score, row_number() over (order by 1 / (60.0::double + l.rank) + coalesce(1 / (60.0::double + d.rank), 0) desc, l.rank)::int as position from lexical l left join dense d on d.id = l.id"))
def rerank_dense(spark, sf_dir):
    """The lexical list in a new order; what only the dense list holds is not added."""
    lexical, dense = two_lists(spark, sf_dir)
    joined = lexical.join(dense.select("id", F.col("rank").alias("d")), "id", "left")
    scored = joined.withColumn("score", 1 / (F.lit(60.0) + F.col("rank")) + F.coalesce(1 / (F.lit(60.0) + F.col("d")), F.lit(0.0)))
    scored = scored.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "rank")))
    return scored.select("id", F.round("score", 6).alias("score"), "position")


SETS = """select file_id, list_distinct(list_filter(string_split_regex(lower(concat_ws(' ', file_path, blurb, purpose, array_to_string(tags, ' '), array_to_string(patterns, ' '))), '[^a-z0-9_]+'), lambda t: len(t) > 1)) as t from files"""


def file_tokens(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("file_id", "file_path", token_set(F.col("file_path"), F.col("blurb"), F.col("purpose"), F.array_join("tags", " "), F.array_join("patterns", " ")).alias("t"))


@query("act_similar", with_views(f"""with s as ({SETS}), p as (select b.file_id as id, len(list_intersect(a.t, b.t))::double / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) as score from s a join s b on a.file_id = 12 and b.file_id <> 12)
select id, round(score, 6) as score from p where score >= 0.05"""))
def act_similar(spark, sf_dir):
    """Files whose descriptions share words with one file's."""
    rows = file_tokens(spark, sf_dir)
    seed = rows.where("file_id = 12").select(F.col("file_id").alias("seed_id"), F.col("t").alias("seed_tokens"))
    return R.similar_to(rows, "file_id", "t", seed, 0.05).select("id", F.round("score", 6).alias("score"))


@query("act_similar_detailed", with_views(f"""with seed as (select unnest(list_distinct({FOLD.format('blurb')})) as term from files where file_id = 12),
{DOCUMENTS}, tok as (select file_id as doc, unnest({FOLD.format('document')}) as term from docs), len as (select file_id as doc, len({FOLD.format('document')}) as dl from docs),
n as (select count(*) as n, avg(dl) as avgdl from len), tf as (select doc, term, count(*) as tf from tok where term in (select term from seed where len(term) > 1) group by all),
df as (select term, count(*) as df from tf group by term),
sc as (select t.doc, sum((case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from tf t join df using (term) join len using (doc) cross join n where t.doc <> 12 group by t.doc)
select doc as id, round(score / max(score) over (), 6) as score from sc"""))
def act_similar_detailed(spark, sf_dir):
    """More like this: the seed's words as a query of the stored index, scores from 0 to 1. The words of
    one blurb are one line of a file, so they are read on the driver as any query is."""
    f = files(spark, sf_dir)
    words = f.where("file_id = 12").select(F.array_distinct(tokens(F.col("blurb"))).alias("t")).first()
    scores = file_index(spark, sf_dir).search([w for w in (words.t if words else None) or [] if len(w) > 1])
    out = scores.where("doc <> 12").select(F.col("doc").alias("id"), (-F.col("score")).alias("score"))
    top = out.agg(F.max("score").alias("top"))
    return out.crossJoin(F.broadcast(top)).select("id", F.round(F.col("score") / F.col("top"), 6).alias("score"))


@query("act_ask", with_views(f"""with {FILE_SCORES} select f.file_path, round(score, 6) as score from scored join files f on f.file_id = doc where f.workspace = 'ws2' and not {TEST_SQL} order by round(score, 9), f.file_path limit 20"""))
def act_ask(spark, sf_dir):
    """Evidence for a question: search without a cluster filter."""
    f, scores = file_scores(spark, sf_dir)
    hits = f.where((F.col("workspace") == "ws2") & ~F.col("file_path").rlike(TEST_PATH)).select("file_id", "file_path").join(scores, F.col("file_id") == F.col("doc"))
    return hits.orderBy(F.round("score", 9), "file_path").limit(20).select("file_path", F.round("score", 6).alias("score"))


@query("act_ask_detailed", with_views(f"""with {FILE_SCORES}, {bm25_sql('changelog', 'id', 'summary', CHANGE_TERMS, 'changed')},
a as (select 'file' as kind, doc as id, row_number() over (order by round(score, 9), doc) as rank from scored qualify rank <= 10),
b as (select 'change' as kind, doc as id, row_number() over (order by round(score, 9), doc) as rank from changed qualify rank <= 20)
select kind, id, round(1 / (60.0::double + rank), 6) as score from (select * from a union all select * from b)"""))
def act_ask_detailed(spark, sf_dir):
    """Files and changes as evidence in one list."""
    _, scores = file_scores(spark, sf_dir)
    a = R.with_rank(scores.orderBy(F.round("score", 9), "doc").limit(10), F.round("score", 9), "doc").select(F.lit("file").alias("kind"), F.col("doc").alias("id"), "rank")
    c = change_scores(spark, sf_dir).orderBy(F.round("score", 9), "doc").limit(20)
    b = R.with_rank(c, F.round("score", 9), "doc").select(F.lit("change").alias("kind"), F.col("doc").alias("id"), "rank")
    return a.unionByName(b).select("kind", "id", F.round(1 / (F.lit(60.0) + F.col("rank")), 6).alias("score"))


#: Parts of words: the full-text index knows none of them.
PARTS = "hatio rbles ntheb"
PART_TERMS = query_terms(PARTS)
HELD = f"""sought as (select file_id, workspace, file_path, {SOUGHT} as t from files),
held as (select file_id, workspace, file_path, {" || ".join(f"case when contains(t, '{w}') then '{w} ' else '' end" for w in sorted(PART_TERMS))} as words from sought)"""


@query("flt_like_indexed", with_views(f"with {HELD} select file_id, trim(words) as words from held where words <> ''"))
def flt_like_indexed(spark, sf_dir):
    """Files that hold any of the words anywhere in their columns, by n-grams, and which ones."""
    return gram_index(spark, sf_dir).any_of(PART_TERMS).select(F.col("doc").alias("file_id"), F.array_join("words", " ").alias("words"))


@query("act_ask_fallback", with_views(f"""with {HELD}, {DOCUMENTS}, {bm25_sql("docs", "file_id", "document", PART_TERMS)},
direct as (select f.file_path, 'fts' as source, row_number() over (order by round(s.score, 9), f.file_path) as rank from scored s join files f on f.file_id = s.doc where f.workspace = 'ws1' qualify rank <= 10),
parts as (select file_path, 'fallback' as source, row_number() over (order by file_path) as rank from held where words <> '' and workspace = 'ws1' and not exists (select 1 from direct) qualify rank <= 10)
select file_path, source, rank::int as rank, case source when 'fts' then null else round(1.0::double / rank, 6) end as score from (select * from direct union all select * from parts)"""))
def act_ask_fallback(spark, sf_dir):
    """Evidence for a question: ranked hits, or, where the full-text index has none, files that hold a part of it."""
    f = files(spark, sf_dir).where("workspace = 'ws1'").select("file_id", "file_path")
    scores = file_index(spark, sf_dir).search(PART_TERMS)
    hits = f.join(scores, F.col("file_id") == F.col("doc")).orderBy(F.round("score", 9), "file_path").limit(10)
    direct = cut(R.with_rank(hits, F.round("score", 9), "file_path").select("file_path", F.lit("fts").alias("source"), "rank", F.lit(None).cast("double").alias("score")))
    if not direct.isEmpty():
        return direct
    held = gram_index(spark, sf_dir).any_of(PART_TERMS).select(F.col("doc").alias("file_id"))
    parts = R.with_rank(f.join(held, "file_id", "left_semi").orderBy("file_path").limit(10), "file_path")
    return parts.select("file_path", F.lit("fallback").alias("source"), "rank", F.round(F.lit(1.0) / F.col("rank"), 6).alias("score"))


@query("jn_fts_files", with_views(f"with {FILE_SCORES} select f.file_id, f.workspace, f.file_path, round(s.score, 6) as score from scored s join files f on f.file_id = s.doc where f.workspace = 'ws0'"))
def jn_fts_files(spark, sf_dir):
    f, scores = file_scores(spark, sf_dir)
    return f.where("workspace = 'ws0'").select("file_id", "workspace", "file_path").join(scores, F.col("file_id") == F.col("doc")).select("file_id", "workspace", "file_path", F.round("score", 6).alias("score"))


@query("jn_fts_changelog", with_views(f"""with {bm25_sql('changelog', 'id', 'summary', CHANGE_TERMS)} select c.id, c.workspace, c.file_path, round(s.score, 6) as score from scored s join changelog c on c.id = s.doc where c.workspace = 'ws1'"""))
def jn_fts_changelog(spark, sf_dir):
    """Full-text hits of the change log with their entries; the workspace is filtered after the match."""
    c = changelog(spark, sf_dir).where("workspace = 'ws1'").select("id", "workspace", "file_path")
    return c.join(change_scores(spark, sf_dir), F.col("id") == F.col("doc")).select("id", "workspace", "file_path", F.round("score", 6).alias("score"))


@query("win_rank", with_views(f"with {FILE_SCORES} select f.file_id, f.workspace, row_number() over (partition by f.workspace order by round(s.score, 9), f.file_path)::int as rank from scored s join files f on f.file_id = s.doc"))
def win_rank(spark, sf_dir):
    """Rank of each hit in its workspace."""
    f, scores = file_scores(spark, sf_dir)
    hits = f.select("file_id", "workspace", "file_path").join(scores, F.col("file_id") == F.col("doc"))
    return R.ranks(hits.withColumn("score", F.round("score", 9)), "workspace", F.col("score"), "file_path").select("file_id", "workspace", "rank")


#: A file's export: its longest word, of equally long ones the least. The least of the files that export a
#: name defines it.
WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_$]+')"
NAMED = f"""words as (select file_id as doc, line, unnest({WORDS}) as word from (select file_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from files)),
named as (select word as symbol, min(doc) as defined from (select doc, arg_min(word, (-length(word), word)) as word from words group by doc) group by word),
hits as (select distinct symbol, doc, line from named join words on word = symbol and doc <> defined)"""
AROUND = """lines as (select file_id as doc, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as line from files),
shown as (select symbol, doc, string_agg(text, chr(10) order by line) as context from (select distinct h.symbol, l.doc, l.line, l.text from hits h join lines l on l.doc = h.doc and l.line between h.line - 2 and h.line + 2) group by all),
counts as (select symbol, doc, count(*) as matches, min(line) as first_line from hits group by all)"""


def places(spark, sf_dir) -> PositionalIndex:
    """The stored positional index over the files' texts."""
    return stored(spark, "places", sf_dir, ("documents",), lambda old: PositionalIndex.build(table(spark, sf_dir, "documents"), "doc_id", F.col("text")))


def exported(spark, sf_dir):
    """(symbol, defined) of all files."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    best = words.groupBy("doc").agg(F.min(F.struct((-F.length("w")).alias("n"), "w")).alias("b"))
    return best.groupBy(F.col("b.w").alias("symbol")).agg(F.min("doc").alias("defined"))


@query("ext_grep_context", with_views(f"with {NAMED}, {AROUND} select symbol, doc, matches::bigint as matches, first_line::int as first_line, sha256(context) as context_sha256 from counts join shown using (symbol, doc)"))
def ext_grep_context(spark, sf_dir):
    """Word search of all exported names in all other files, with two lines of context (as a digest)."""
    found = places(spark, sf_dir).grep(exported(spark, sf_dir))
    return found.select("symbol", "doc", "matches", "first_line", F.sha2("context", 256).alias("context_sha256"))


@query("agg_call_site_contexts", with_views(f"""with {NAMED}, {AROUND}
select symbol, (row_number() over (partition by symbol order by matches desc, doc))::int as rank, doc, matches::bigint as matches, sha256(context) as context_sha256
from counts join shown using (symbol, doc) qualify rank <= 5"""))
def agg_call_site_contexts(spark, sf_dir):
    """The five files that use an exported name most, with the lines around its uses (as a digest)."""
    found = places(spark, sf_dir).call_sites(exported(spark, sf_dir), 5)
    return found.select("symbol", "rank", "doc", "matches", F.sha2("context", 256).alias("context_sha256"))


@query("aud_exports_unseen", with_views(f"with {NAMED} select symbol, defined from named where symbol not in (select symbol from hits)"))
def aud_exports_unseen(spark, sf_dir):
    """Exported names that no other file holds as a word."""
    return places(spark, sf_dir).unseen(exported(spark, sf_dir))
