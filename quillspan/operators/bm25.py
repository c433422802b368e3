"""BM25 ranking as an inverted-index join on terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.5, 0.75
#: Rows (query, term) that go to all tasks at most.
MOST_TERMS = 500_000


def term_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf)"""
    return docs.select(F.col(key), F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame, key: str) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def scores(docs: DataFrame, doc_key: str, doc_tokens: Column, queries: DataFrame, query_key: str, query_tokens: Column, patched: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """(query_key, doc_key, score) of the pairs that share a term.

    A query term counts as often as it stands. patched: negative inverse frequencies become a quarter of the mean one.
    Documents are split into words once; words that no query has are dropped before the one shuffle, which is by document:
    counts, weights and sums follow in place. The queries' terms are counted and go to all tasks if they are at most
    MOST_TERMS rows; beyond it they are joined by term, where Spark splits frequent ones. (The patched mean is over all
    words, which are counted apart.)
    """
    qtf = term_counts(queries, query_key, query_tokens).withColumnRenamed("tf", "qtf")
    small = F.broadcast if qtf.count() <= MOST_TERMS else lambda df: df
    no_word = qtf.sparkSession.createDataFrame([("",)], "term string")  # every document's own row, with its length
    asked = qtf.select("term").union(no_word).distinct()
    words = docs.select(F.col(doc_key), F.coalesce(doc_tokens, F.array().cast("array<string>")).alias("words"))
    each = words.select(doc_key, F.size("words").cast("long").alias("dl"), F.explode(F.concat("words", F.array(F.lit("")))).alias("term"))
    each = each.join(small(asked), "term", "left_semi").repartition(doc_key)
    tf = each.groupBy(doc_key, "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    own = F.col("term") == ""
    stats = tf.agg(F.sum(F.when(own, F.col("tf"))).alias("n_docs"), (F.sum(F.when(own, F.col("tf") * F.col("dl"))) / F.sum(F.when(own, F.col("tf")))).alias("avgdl"))
    if patched:
        seen = words.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        df = seen.crossJoin(F.broadcast(stats))  # one row
        idf = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        df = df.withColumn("idf", idf)
        mean = df.agg(F.avg("idf").alias("mean_idf"))
        df = df.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, 0.25 * F.col("mean_idf")).otherwise(F.col("idf"))).drop("mean_idf")
    else:
        df = document_frequency(tf, doc_key).crossJoin(F.broadcast(stats))
        df = df.withColumn("idf", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    weighted = qtf.join(df, "term").select(query_key, "term", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl")
    part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return tf.join(small(weighted), "term").groupBy(query_key, doc_key).agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, query_key: str, doc_key: str, k: int, least: float = 0.0, digits: int | None = None) -> DataFrame:
    """The k best with a score over `least`; ties go to the largest key. digits: scores that agree to so many places tie."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    w = Window.partitionBy(query_key).orderBy(score.desc(), F.desc(doc_key))
    return scored.where(F.col("score") > least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
