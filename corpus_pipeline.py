"""A corpus from documents: language, near copies, benchmark items, mixture, shards.

Every stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each one's result to the
shared folder and reads it back for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.functions.session import written
from tabspark.llm.catalog import let_workers_import
from tabspark.llm.decontaminate import decontaminate
from tabspark.llm.language import fit_languages, predict_language
from tabspark.llm.mixing import mix_sources
from tabspark.llm.near_dedup import near_duplicates
from tabspark.llm.sharding import extendible_shards

SHARD_BYTES = 1 << 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; rejected ones go: those without
    letters, and those of a cross-entropy far above that of the language's own texts."""
    model = fit_languages(docs)
    found = predict_language(docs, model, keep=docs.columns)
    return found.where("NOT rejected").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of least id.
    Equal rows are copies too; different texts of one id are different documents. Rows without an id stay."""
    named = docs.where("doc_id IS NOT NULL").distinct().sort("doc_id", F.xxhash64("text"))
    named = written(named.withColumn("_row", F.monotonically_increasing_id()))
    gone = near_duplicates(named, id="_row", n=5, percent=80).where("NOT kept").select("_row")
    left = named.join(written(gone), "_row", "left_anti").select(*docs.columns)
    return left.union(docs.where("doc_id IS NULL"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it (0 to 3 times)."""
    taken = mix_sources(docs, keep=docs.columns).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard of each; copies of a document share a hash and so a shard."""
    return extendible_shards(docs, SHARD_BYTES)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("benchmark", benchmark),
    ("mixture", mixture),
    ("shards", shards),
]

# Language models, similarity links and hashed copies are beyond SQL; tests hold every stage against
# a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    let_workers_import(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
