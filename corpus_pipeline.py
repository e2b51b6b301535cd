"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language, minhash, mixing, sharding
from lodestone.llm.common import store


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts and texts without a letter go.

    The model is fitted on the documents that reach this stage, held-out ones excluded. Where no
    document has a language, nothing can be recognised and nothing is rejected.
    """
    learned = language.samples(docs)
    if not learned:
        return docs
    own = {c: f"__own_{c}" for c in docs.columns if c in ("lang_pred", "score")}
    named = language.identify(docs.withColumnsRenamed(own), learned).where(F.col("lang_pred") != language.UNKNOWN)
    named = named.drop("lang_pred", "score").withColumnsRenamed({new: old for old, new in own.items()})
    return named.select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The document with the smallest id stays. Of rows that repeat an id, all stay or all go; rows with
    a null id stay unless they are near-duplicates of a row that has one.
    """
    found = minhash.near_duplicates(docs)
    gone = found.groupBy(found["doc_id"].alias("gone")).agg(F.max("kept").alias("kept")).where("not kept").select("gone")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone"]), "left_anti")


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document may repeat."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its slot and shard."""
    return sharding.assign(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]
#: The first three stages have no SQL equivalent; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = store(docs, name)
    return docs
