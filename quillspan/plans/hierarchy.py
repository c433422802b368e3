"""Hierarchy and multi-label queries: embeddings stand for class probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.raster import sigmoid
from quillspan.operators import dag, metrics, models, split
from quillspan.plans.registry import query, table
from quillspan.sources import readers

CLASSES = 64


def edges(spark) -> DataFrame:
    """Classes 0..63 with parents i div 2 and i div 3."""
    i = spark.range(1, CLASSES).select(F.col("id").alias("child"))
    return i.select("child", F.explode(F.array(F.expr("child div 2"), F.expr("child div 3"))).alias("parent")).distinct()


def probabilities(spark, sf_dir: str) -> DataFrame:
    """(vec_id, class_id, prob, label): sigmoids of all elements, the label marks its class."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("class_id", "x"))
    return e.select("vec_id", F.col("class_id").cast("long").alias("class_id"), sigmoid(F.col("x").cast("double")).alias("prob"), (F.col("class_id") == F.col("label")).cast("int").alias("label"))


EDGES = "edges AS (SELECT DISTINCT i AS child, p AS parent FROM (SELECT i, unnest([i // 2, i // 3]) AS p FROM range(1, 64) t(i)))"
CLOSURE = f"WITH RECURSIVE {EDGES}, pairs AS (SELECT i AS node, i AS ancestor FROM range(0, 64) t(i) UNION SELECT p.node, e.parent FROM pairs p JOIN edges e ON p.ancestor = e.child)"
PROBS = "probs AS (SELECT vec_id, (k - 1)::BIGINT AS class_id, 1 / (1 + exp(-(embedding[k]::DOUBLE))) AS prob, (k - 1 = label)::INTEGER AS label FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings))"
BY_CLASS = """, by_class AS (SELECT class_id, sum((label > 0 AND p)::INT) AS tp, sum((label = 0 AND p)::INT) AS fp, sum((label > 0 AND NOT p)::INT) AS fn FROM (SELECT *, prob > 0.5 AS p FROM probs) GROUP BY ALL),
f AS (SELECT class_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM by_class)"""


@query(CLOSURE + " SELECT node, ancestor FROM pairs")
def dag_closure(spark, sf_dir):
    pairs = dag.closure(edges(spark))
    return pairs.select(F.col("node"), F.col("ancestor"))


@query(CLOSURE + f", {PROBS} SELECT vec_id, ancestor AS class_id, max(label)::INTEGER AS label FROM probs JOIN pairs ON class_id = node GROUP BY ALL")
def dag_hard_propagate(spark, sf_dir):
    return dag.hard_propagate(probabilities(spark, sf_dir).select("vec_id", "class_id", "label"), dag.closure(edges(spark)), "vec_id")


@query(CLOSURE + f", {PROBS} SELECT vec_id, node AS class_id, round(min(prob), 6) AS prob FROM probs JOIN pairs ON class_id = ancestor GROUP BY ALL")
def dag_soft_propagate(spark, sf_dir):
    return dag.soft_propagate(probabilities(spark, sf_dir), edges(spark), "vec_id").withColumn("prob", F.round("prob", 6))


@query(
    CLOSURE + f""", {PROBS}, after AS (SELECT vec_id, node AS class_id, min(prob) AS prob FROM probs JOIN pairs ON class_id = ancestor GROUP BY ALL)
SELECT stage, count(*) AS n_pairs, CAST(sum((c.prob > p.prob)::INT) AS BIGINT) AS n_inconsistent FROM (SELECT 'raw' AS stage, vec_id, class_id, prob FROM probs UNION ALL SELECT 'propagated', * FROM after) c
JOIN edges ON c.class_id = child JOIN (SELECT 'raw' AS stage, vec_id, class_id, prob FROM probs UNION ALL SELECT 'propagated', * FROM after) p USING (stage, vec_id) WHERE p.class_id = parent GROUP BY ALL"""
)
def dag_inconsistency(spark, sf_dir):
    probs, e = probabilities(spark, sf_dir), edges(spark)
    raw = dag.inconsistencies(probs, e, "vec_id").withColumn("stage", F.lit("raw"))
    return raw.unionByName(dag.inconsistencies(dag.soft_propagate(probs, e, "vec_id"), e, "vec_id").withColumn("stage", F.lit("propagated")))


@query(
    """WITH pairs AS (SELECT n_name AS node, n_name AS ancestor FROM nation UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, 'WORLD' FROM nation)
SELECT ancestor AS place, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN pairs ON node = n_name GROUP BY ALL"""
)
def geo_rollup_dag(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    pairs = dag.closure(up.union(region.select("r_name", F.lit("WORLD"))))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(pairs, F.col("n_name") == F.col("node"))
    return rows.groupBy(F.col("ancestor").alias("place")).agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query(f"WITH {PROBS} SELECT class_id, CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg, round((count(*) - sum(label))::DOUBLE / greatest(sum(label), 1), 4) AS weight FROM probs GROUP BY ALL")
def class_balance(spark, sf_dir):
    return metrics.class_balance(probabilities(spark, sf_dir)).withColumn("weight", F.round("weight", 4))


@query(f"WITH {PROBS}{BY_CLASS} SELECT class_id, tp, fp, fn, round(f1, 6) AS f1 FROM f")
def f1_per_class(spark, sf_dir):
    return metrics.f1_by_class(probabilities(spark, sf_dir), F.col("prob") > 0.5).withColumn("f1", F.round("f1", 6))


@query(f"WITH {PROBS}{BY_CLASS} SELECT round(avg(f1), 6) AS macro_f1, count(*) AS n_classes FROM f")
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(metrics.f1_by_class(probabilities(spark, sf_dir), F.col("prob") > 0.5)).withColumn("macro_f1", F.round("macro_f1", 6))


@query(
    f"""WITH {PROBS}, t AS (SELECT i, 0.05::DOUBLE + i * (0.95::DOUBLE - 0.05::DOUBLE) / 49::DOUBLE AS threshold FROM range(0, 50) r(i)),
c AS (SELECT class_id, i, threshold, sum((label > 0 AND prob >= threshold)::INT) AS tp, sum((label = 0 AND prob >= threshold)::INT) AS fp, sum((label > 0 AND prob < threshold)::INT) AS fn FROM probs, t GROUP BY ALL),
s AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY f1 DESC, i) AS rn FROM s)
SELECT class_id, round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM r WHERE rn = 1"""
)
def threshold_grid(spark, sf_dir):
    return metrics.grid_thresholds(probabilities(spark, sf_dir)).select("class_id", F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


@query(
    f"""WITH {PROBS}, g AS (SELECT class_id, prob, sum(label) AS pos, count(*) AS n FROM probs GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS picked, sum(pos) OVER (PARTITION BY class_id) AS all_pos FROM g WINDOW w AS (PARTITION BY class_id ORDER BY prob DESC)),
pr AS (SELECT *, tp::DOUBLE / picked AS p, CASE WHEN all_pos > 0 THEN tp::DOUBLE / all_pos ELSE 1 END AS r FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY 2 * p * r / (p + r + 1e-8::DOUBLE) DESC, prob) AS rn FROM pr)
SELECT class_id, round(greatest(0.05, least(0.95, prob)), 6)::DOUBLE AS threshold FROM r WHERE rn = 1"""
)
def threshold_pr_curve(spark, sf_dir):
    return metrics.curve_thresholds(probabilities(spark, sf_dir)).select("class_id", F.round("threshold", 6).alias("threshold"))


@query(
    f"""WITH {PROBS}, f AS (SELECT vec_id, class_id, fold, prob * (1 - 0.1::DOUBLE * fold) AS prob FROM probs, range(0, 3) t(fold)), m AS (SELECT vec_id, class_id, avg(prob) AS prob FROM f GROUP BY ALL)
SELECT vec_id, class_id, round(prob, 6) AS prob, (prob >= 0.4::DOUBLE + 0.002::DOUBLE * class_id)::INTEGER AS predicted FROM m"""
)
def fold_ensemble(spark, sf_dir):
    folds = probabilities(spark, sf_dir).select("vec_id", "class_id", "prob", F.explode(F.array(*map(F.lit, range(3)))).alias("fold"))
    mean = metrics.fold_means(folds.withColumn("prob", F.col("prob") * (1 - F.lit(0.1) * F.col("fold"))), ["vec_id", "class_id"])
    limits = spark.range(CLASSES).select(F.col("id").alias("class_id"), (F.lit(0.4) + F.lit(0.002) * F.col("id")).alias("threshold"))
    return metrics.apply_thresholds(mean, limits).select("vec_id", "class_id", F.round("prob", 6).alias("prob"), "predicted")


@query(
    """WITH g AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), r AS (SELECT source, fold, row_number() OVER (PARTITION BY fold ORDER BY md5('42/' || fold || '/' || source), source) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM g, range(0, 3) t(fold))
SELECT source, fold::INTEGER AS fold, rn <= ceil(0.2 * n) AS is_val FROM r"""
)
def group_split(spark, sf_dir):
    return split.group_split(table(spark, sf_dir, "documents"), "source")


@query("SELECT 'class_' || (n_nationkey + 100) AS child, 'class_' || n_regionkey AS parent FROM nation UNION ALL SELECT 'class_' || (n_nationkey + 100), 'class_' || (n_regionkey + 1) || ' ! ' || n_name FROM nation")
def obo_parse(spark, sf_dir):
    """OBO text made of nations: a stanza each, a second id of another kind, and a commented parent."""
    n = table(spark, sf_dir, "nation")
    stanza = F.array(
        F.lit("[Term]"), F.concat(F.lit("id: class_"), (F.col("n_nationkey") + 100).cast("string")), F.concat(F.lit("is_a: class_"), F.col("n_regionkey").cast("string")), F.lit("[Term]"),
        F.concat(F.lit("id: OTHER:"), F.col("n_nationkey").cast("string")), F.concat(F.lit("is_a: class_"), (F.col("n_regionkey") + 1).cast("string"), F.lit(" ! "), F.col("n_name")),
    )
    lines = n.select(F.col("n_nationkey").alias("file"), F.posexplode(stanza).alias("pos", "line"))
    return readers.obo_edges(lines).select("child", "parent")


@query(f"WITH {PROBS} SELECT vec_id, class_id, round(prob, 6) AS prob FROM probs WHERE class_id < 4")
def wide_to_long(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    wide = e.select("vec_id", *(F.round(sigmoid(F.get("embedding", F.lit(i)).cast("double")), 6).alias(f"class_{i}") for i in (3, 1, 0, 2)))
    columns = readers.class_columns(wide.columns, drop="")
    return readers.wide_to_long(wide, ["vec_id"], columns, value="prob").withColumn("class_id", F.expr("cast(substring(class_id, 7) as long)"))


@query("SELECT vec_id, 1 AS class_0, " + ", ".join(f"round(1 / (1 + exp(-(embedding[{i + 1}]::DOUBLE))), 6) AS class_{i}" for i in range(1, 5)) + " FROM embeddings")
def long_to_wide(spark, sf_dir):
    long = probabilities(spark, sf_dir).where("class_id between 1 and 4").select("vec_id", F.concat(F.lit("class_"), F.col("class_id").cast("string")).alias("class_id"), F.round("prob", 6).alias("prob"))
    return readers.long_to_wide(long, "vec_id", [f"class_{i}" for i in range(1, 5)], value="prob", constant={"class_0": 1})


@query(f"WITH {PROBS} SELECT vec_id, class_id, round(prob, 6) AS prob FROM probs")
def wide_to_long_all(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    wide = e.select("vec_id", *(F.round(sigmoid(F.get("embedding", F.lit(i)).cast("double")), 6).alias(f"class_{i}") for i in reversed(range(CLASSES))))
    columns = readers.class_columns(wide.columns, drop="")
    return readers.wide_to_long(wide, ["vec_id"], columns, value="prob").withColumn("class_id", F.expr("cast(substring(class_id, 7) as long)"))


@query("SELECT vec_id, 1 AS class_0, " + ", ".join(f"round(1 / (1 + exp(-(embedding[{i + 1}]::DOUBLE))), 6) AS class_{i}" for i in range(1, CLASSES)) + " FROM embeddings")
def long_to_wide_all(spark, sf_dir):
    long = probabilities(spark, sf_dir).where("class_id > 0").select("vec_id", F.concat(F.lit("class_"), F.col("class_id").cast("string")).alias("class_id"), F.round("prob", 6).alias("prob"))
    return readers.long_to_wide(long, "vec_id", [f"class_{i}" for i in range(1, CLASSES)], value="prob", constant={"class_0": 1})


@query("SELECT 'train' AS split, doc_id AS id, length(text) AS n FROM documents UNION ALL SELECT 'test', item_id, length(text) FROM benchmark")
def union_split(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.lit("train").alias("split"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("n"))
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("test").alias("split"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("n")))


@query()
def gbt_per_class(spark, sf_dir):
    """Boosters for all classes but the root, which is always 1; labels and probabilities are made consistent with the hierarchy."""
    up = edges(spark)
    above = dag.closure(up).groupBy(F.col("node").alias("label")).agg(F.collect_set("ancestor").alias("__above"))
    e = table(spark, sf_dir, "embeddings").join(F.broadcast(above), "label", "left")
    classes = [f"class_{i}" for i in range(1, CLASSES)]
    wide = e.select("vec_id", "embedding", *(F.coalesce(F.array_contains("__above", F.lit(i).cast("long")), F.lit(False)).cast("int").alias(f"class_{i}") for i in range(1, CLASSES)))
    fitted = models.gbt_per_class(wide, "embedding", classes)
    probs = models.class_probabilities(fitted, wide, "embedding", "vec_id", classes).cache()  # each step of the closure reads it
    named = up.select(*(F.concat(F.lit("class_"), F.col(c).cast("string")).alias(c) for c in ("child", "parent")))
    root = wide.select("vec_id", F.lit("class_0").alias("class_id"), F.lit(1.0).alias("prob"))
    return dag.soft_propagate(probs, named, "vec_id").unionByName(root)
