import corpus_pipeline as P
from lodestone.llm import decontaminate, language


def test_stages(spark):
    """Each stage against what the operators' brute-force versions say of its input."""
    from test_minhash import brute

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(5000, None, "en", "src0", 0), (5001, "12 34", "en", "src0", 5)], docs.schema)
    docs = docs.unionByName(extra)
    named = P.known_language(spark, docs, sf)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in named.collect()} == {5000, 5001} and named.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in named.collect()]
    single = P.one_of_each(spark, named, sf)
    want = {i for i, _, c in brute(texts, 5) if i == c}
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, t in texts if any(decontaminate.normalise(x) in decontaminate.normalise(t) for x in items)}
    kept = {r.doc_id for r in P.uncontaminated(spark, single, sf).collect()}
    assert want - kept >= leaks & want and len(want - kept) <= len(leaks & want) + 2


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "shard"]
    assert [name for name, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    assert out.count() > 100


def test_stages_of_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
    assert language.samples(docs.drop("slot")) == ()


def test_nulls(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "one two three four five six seven", None, None, None), (9000, "", "en", "src1", 0)], docs.schema)
    docs = docs.unionByName(odd)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0


def test_columns_that_stages_use_inside_stay(spark):
    """Own columns that bear the names of results come out as they went in; repeated rows and long texts too."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).selectExpr("doc_id + 100000 as doc_id", "repeat(text, 300) as text", "lang", "source", "n_chars"))
    docs = docs.selectExpr("*", "7.5D as score", "'mine' as lang_pred", "3 as kept", "9L as component_id")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        rows = docs.select("score", "lang_pred", "kept", "component_id").distinct().collect()
        assert [tuple(r) for r in rows] == [(7.5, "mine", 3, 9)], name
