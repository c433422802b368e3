"""Every registered query and the pipeline, whole, on small awkward, empty and null tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import common, license, mixing
from quillspan.llm.queries import QUERIES
from tests.llm.fixtures import DOCS, awkward, empty
from tests.oracle import duck

PAGES = "page_id long, url string, html string, text string, host string"
COLUMNS = {
    "op1_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2_language_id": "doc_id held_out lang_pred score",
    "op3_url_filter": "page_id host path rule verdict",
    "op4_mixing": "doc_id size source_size target taken",
    "op5_embedding_near_dedup": "vec_id n_links component_id kept",
    "op6_html_extraction": "page_id url text n_chars",
    "op7_token_counts": "doc_id n_tokens",
    "op8_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op9_ngram_jaccard_join": "doc_id class_id n_links",
    "op10_toxicity": "doc_id held_out score predicted",
}


def write(spark, folder, kind):
    docs = {"awkward": awkward, "empty": empty, "null": lambda s: s.createDataFrame([(None,) * 9] * 3, DOCS)}[kind](spark)
    some = kind == "awkward"
    first = [r["text"] for r in awkward(spark).where("doc_id < 3").collect()]
    tables = {
        "documents": docs,
        "benchmark": spark.createDataFrame([(i, t) for i, t in enumerate(first)] + [(None, None)] if some else [(None, None)] if kind == "null" else [], "item_id long, text string"),
        "labels": spark.createDataFrame([(i, i % 3, int(i % 4 == 0)) for i in range(50)] + [(None, None, None)] if some else [(None, None, None)] if kind == "null" else [], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(1, "http://a.net/x", "<p>One, two", "t", "h"), (1, "http://a.net/x", "<p>One, two", "t", "h"), (None, None, None, None, None)] if some else [(None,) * 5] if kind == "null" else [], PAGES),
        "embeddings": spark.createDataFrame([(1, [1.0, 0.5], 2, "n"), (2, [1.0, 0.5], 2, "n"), (3, None, None, None), (4, [1.0, 0.6], 1, "n"), (None, None, None, None)] if some else [(None,) * 4] if kind == "null" else [], "vec_id long, embedding array<float>, label int, node string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder), tables


@pytest.mark.parametrize("kind", ["awkward", "empty", "null"])
def test_all_queries_give_a_row_for_each_row(spark, tmp_path, kind):
    folder, tables = write(spark, tmp_path, kind)
    for name, query in QUERIES.items():
        found = query(spark, folder)
        asked = COLUMNS[name].split()
        assert found.columns[: len(asked)] == asked or set(asked) <= set(found.columns), name
        source = "pages" if asked[0] == "page_id" else "embeddings" if asked[0] == "vec_id" else "documents"
        key = asked[0]
        assert sorted(map(repr, (r[0] for r in found.select(key).collect()))) == sorted(map(repr, (r[0] for r in tables[source].select(key).collect()))), name


@pytest.mark.parametrize("kind", ["awkward", "empty", "null"])
def test_pipeline_runs_whole(spark, tmp_path, kind):
    folder, tables = write(spark, tmp_path, kind)
    before = common.marked()
    found = corpus_pipeline.run(spark, folder)
    rows = found.collect()
    assert common.marked() == before + 1  # only the result is left
    held = {r["doc_id"]: r["text"] for r in tables["documents"].collect() if r["text"]}
    assert all(r["text"] in held[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert bool(rows) == (kind == "awkward")
    assert not {0, 1, 2} & {r["doc_id"] for r in rows}  # benchmark texts


def test_stages_of_wordless_rows(spark, tmp_path):
    """A stage that filters keeps what it has no reason to reject."""
    folder, tables = write(spark, tmp_path, "awkward")
    stage, docs = dict(corpus_pipeline.STAGES), tables["documents"]
    wordless = docs.where("text is null or text in ('', '   \n\t')").count()
    for name in ("toxicity", "near_duplicates", "decontamination"):
        kept = stage[name](spark, docs, folder)
        assert kept.columns == docs.columns
        assert kept.where("text is null or text in ('', '   \n\t')").count() == wordless, name


def test_base_columns_of_licenses_same_as_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = license.digest(license.scan(docs)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    sql = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(phrase, label) AS (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')),
m AS (SELECT doc_id, label, k - 1 AS place FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d), p WHERE w[k:k + len(phrase) - 1] = phrase)
SELECT d.doc_id, len(w)::BIGINT AS n_words, count(label) AS n_base, min(place)::BIGINT AS first_word, max(place)::BIGINT AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id, w"""
    assert sorted(map(tuple, found.collect())) == sorted(duck(sf_dir).sql(sql).fetchall())


def test_sizes_and_targets_same_as_sql(spark, sf_dir):
    planned = mixing.plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]).select("doc_id", F.col("__size").alias("size"), "source_size")
    sql = r"WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents) SELECT doc_id, size, sum(size) OVER (PARTITION BY source)::BIGINT FROM d"
    assert sorted(map(tuple, planned.collect())) == sorted(duck(sf_dir).sql(sql).fetchall())
