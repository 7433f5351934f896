"""A corpus run through five of the operators: each stage reads what the one before wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from cohortlab.llm.queries import QUALITY_WEIGHTS
from cohortlab.session import bound_batches, cut_lineage, fresh_path, ship_package


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    bound_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    _prepare(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays, then the one with the smallest id."""
    _prepare(spark)
    return exact_dedup.drop_copies(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays (with it repeated: one of its rows)."""
    _prepare(spark)
    # ids may repeat with other texts, so a row is known by its id and its text
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    rows = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    groups = ngram_join.similar_groups(rows.select("_key", F.col("_doc.text").alias("text")), "_key")
    kept = groups.filter("_id = component_id").select(F.col("_id").alias("_key"))
    return rows.join(kept.distinct(), "_key").dropDuplicates(["_key"]).select("_doc.*")


def mix_qualities(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality are thinned to their target weight; the others stay."""
    _prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = mixing.train(docs, labels, F.col("quality"), len(QUALITY_WEIGHTS))
    narrow = cut_lineage(mixing.posteriors(docs, model, len(QUALITY_WEIGHTS)))
    rates, _, _ = mixing.fit_rates(narrow, QUALITY_WEIGHTS, most=1.0)
    return mixing.thin(docs, model, rates, len(QUALITY_WEIGHTS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    _prepare(spark)
    return bpe.encode(docs, bpe.vocabulary("byte_bpe_50k.json")).withColumnRenamed("_id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("n-gram Jaccard join", one_of_similar),
    ("mixing to target weights", mix_qualities), ("BPE encoding", tokens),
]

#: SQL can express neither the classifier nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
