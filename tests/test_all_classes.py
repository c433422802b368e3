"""Queries over class columns take all of them."""

from quillspan.plans import hierarchy
from quillspan.plans.catalog import QUERIES


def test_reshapes_hold_every_class(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    long = QUERIES["wide_to_long_all"](spark, sf_dir)
    assert {r["class_id"]: r["count"] for r in long.groupBy("class_id").count().collect()} == dict.fromkeys(range(hierarchy.CLASSES), n)
    assert set(QUERIES["long_to_wide_all"](spark, sf_dir).columns) == {"vec_id", *(f"class_{i}" for i in range(hierarchy.CLASSES))}


def test_boosters_cover_every_class(spark, sf_dir, monkeypatch):
    asked = {}
    fit = hierarchy.models.gbt_per_class
    monkeypatch.setattr(hierarchy.models, "gbt_per_class", lambda wide, features, classes, **k: asked.update(k, classes=classes) or fit(wide, features, classes, rounds=1, depth=1))
    rows = QUERIES["gbt_per_class"](spark, sf_dir).collect()
    assert asked == {"classes": [f"class_{i}" for i in range(1, hierarchy.CLASSES)]}  # the operator's own rounds and depth
    p = {(r["vec_id"], r["class_id"]): r["prob"] for r in rows}
    ids = {i for i, _ in p}
    assert len(p) == len(rows) == hierarchy.CLASSES * len(ids)
    assert all(p[i, "class_0"] == 1 for i in ids)
    assert all(p[i, f"class_{c}"] <= p[i, f"class_{c // k}"] for i in ids for c in range(1, hierarchy.CLASSES) for k in (2, 3))
