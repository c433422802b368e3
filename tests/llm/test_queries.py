import pytest

import corpus_pipeline
from quillspan.llm import decontam, ngramjoin
from quillspan.llm.queries import ORACLES, QUERIES
from tests.oracle import mismatch


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert mismatch(spark, sf_dir, QUERIES[name], ORACLES[name]) is None


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "decontamination", "mixing"]
    stage = dict(corpus_pipeline.STAGES)
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = stage["decontamination"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    bad = {r[0] for r in decontam.brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], benchmark) if r[5]}
    assert bad and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    once = stage["near_duplicates"](spark, docs, sf_dir)
    assert once.columns == docs.columns
    again = ngramjoin.join(once)
    assert again.where("n_links > 0").count() <= 0.02 * docs.count()
    clean = stage["language"](spark, stage["toxicity"](spark, docs, sf_dir), sf_dir)
    assert clean.columns == docs.columns
    assert 0.8 * docs.count() < clean.count() < docs.count()
    assert stage["mixing"](spark, once, sf_dir).count() > 0
