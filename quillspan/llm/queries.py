"""Thin queries over the driver tables: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontam, embedding, html, langid, license, mixing, ngramjoin, tokencount, toxicity, urlfilter

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("shares").alias("n_langs"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), ["page_id"])


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"), ["doc_id"])
    return planned.select("doc_id", F.col("__size").alias("size"), "source_size", "target", mixing.taken().alias("taken"))


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.digest(license.scan(table(spark, sf_dir, "documents")))


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngramjoin.join(table(spark, sf_dir, "documents"))
    real = lambda c: F.when(F.col(c) != ngramjoin.LAST, F.col(c))
    return found.select(real("key").alias("doc_id"), real("class_key").alias("class_id"), "n_links", "n_grams")


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", F.size("sentences").alias("n_offending"))


#: Words as the contracts take them, in DuckDB.
_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op3_url_filter"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, q, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT p.*, h || q AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || q) DESC, length(h) DESC) AS rn
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN EXISTS (
  SELECT 1 FROM (VALUES ('cheap-pills.example.com'), ('spam-farm.example.org')) b(k) WHERE host = k OR ends_with(host, '.' || k)
) THEN 'block' ELSE 'allow' END) AS verdict
FROM m WHERE rn = 1
"""

ORACLES["op1_decontamination"] = """
WITH i AS (SELECT item_id, {item} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (
  SELECT item_id, k AS win_id, least(10, len(w)) AS n, w[k:k + 9] AS ws, array_to_string(w[k:k + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)
), d AS (SELECT doc_id, {text} AS w FROM documents),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), hit AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN wins ON dw.n = wins.n AND dw.win = wins.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id),
wt AS (SELECT item_id, win_id, n, unnest(ws) AS t, unnest(range(0, n)) AS o FROM wins WHERE item_id IS NOT NULL),
dt AS (SELECT doc_id, unnest(w) AS t, unnest(range(0, len(w))) AS p FROM d),
near AS (
  SELECT DISTINCT doc_id, item_id FROM (
    SELECT doc_id, item_id, win_id, n, p - o + s AS a, bit_or((1 << o)::INTEGER) AS m
    FROM dt JOIN wt USING (t), (SELECT unnest(range(-2, 3)) AS s) GROUP BY ALL
  ) WHERE m = (1 << n) - 1
), close AS (SELECT doc_id, count(*) AS n_near FROM (SELECT * FROM near EXCEPT SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(coalesce(w, []))::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN close USING (doc_id)
""".format(item=_WORDS.format("text"), text=_WORDS.format("text"))
