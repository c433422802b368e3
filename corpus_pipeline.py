"""A corpus pipeline: toxicity, language ID, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs. run()
applies them to the documents table, writing each stage's rows as Parquet into the shared folder for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontam, langid, mixing, ngramjoin, toxicity
from quillspan.llm.common import marked, release, stored

#: Documents with a toxicity score of as much go.
TOXIC = 0.5
#: Documents go whose largest language has a smaller share of the words, or that have no letters.
LEAST_SHARE = 0.4


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = toxicity.toxicity(docs, labels, docs.columns, locate=None, prefix="__")
    return kept.where(F.col("__score") < TOXIC).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, docs.columns, prefix="__")
    return found.where((F.col("__lang_pred") != "und") & (F.col("__score") >= LEAST_SHARE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.one_of_each(docs, ngramjoin.join(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go; rows that share id and text share the verdict."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontam.decontaminate(docs, benchmark, keep_key=True).where(F.size("hits") > 0).select("doc_id", "key").distinct()
    hit = hit.select(F.col("doc_id").alias("__id"), F.col("key").alias("__text"))
    marked = docs.withColumn("__text", F.xxhash64("text")).withColumn("__id", F.col("doc_id").cast("long"))
    same = marked["__id"].eqNullSafe(hit["__id"]) & (marked["__text"] == hit["__text"])
    return marked.join(hit, same, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]

#: Learned scores, MinHash and seeded draws have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage has stored for itself, and its input, goes once its rows are written."""
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), marked()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, mark, docs)  # the stage's input too, but for the documents themselves
    return docs
