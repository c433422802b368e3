"""Multi-label metrics and thresholds over long tables (key, class_id, prob, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID = 50
LOW, HIGH = 0.05, 0.95
#: Stretches of scores in which a class's curve is summed.
BINS = 1024


def class_balance(df: DataFrame, label: str = "label", by: str = "class_id") -> DataFrame:
    pos = F.sum(F.col(label).cast("long"))
    return df.groupBy(by).agg(pos.alias("n_pos"), (F.count(F.lit(1)) - pos).alias("n_neg")).withColumn("weight", F.col("n_neg") / F.greatest("n_pos", F.lit(1)))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where nothing is positive."""
    den = 2 * tp + fp + fn
    return F.when(den == 0, 0.0).otherwise(2.0 * tp / den)


def _counts(label: str, predicted: Column) -> tuple[Column, Column, Column]:
    y, p = F.col(label) > 0, predicted
    return tuple(F.sum(x.cast("long")) for x in (y & p, ~y & p, y & ~p))


def f1_by_class(df: DataFrame, predicted: Column, label: str = "label", by: str = "class_id") -> DataFrame:
    tp, fp, fn = _counts(label, predicted)
    return df.groupBy(by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_f1(by_class: DataFrame) -> DataFrame:
    """Mean over all classes; those without positives count with 0."""
    return by_class.agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def grid_thresholds(df: DataFrame, label: str = "label", by: str = "class_id", prob: str = "prob", points: int = GRID) -> DataFrame:
    """The first threshold of an even grid with the best F1 (p >= t).

    A score passes the thresholds up to its grid step, so rows are first counted by (class, step), and the counts of a
    class are summed from the top: rows aren't multiplied by the grid.
    """
    width = (HIGH - LOW) / (points - 1)
    t = lambda i: F.lit(LOW) + i * F.lit(HIGH - LOW) / F.lit(points - 1)
    guess = F.floor((F.col(prob) - LOW) / width).cast("int")
    near = [F.greatest(F.lit(-1), F.least(F.lit(points - 1), guess + d)) for d in (1, 0, -1)]
    step = F.coalesce(*(F.when((s >= 0) & (F.col(prob) >= t(s)), s) for s in near), F.lit(-1))
    counts = df.withColumn("step", step).groupBy(by, "step").agg(F.sum((F.col(label) > 0).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(by).agg(F.sum("pos").alias("all_pos"))
    full = totals.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).join(counts, [by, "step"], "left")
    w = Window.partitionBy(by).orderBy(F.desc("step"))
    full = full.withColumn("tp", F.sum(F.coalesce("pos", F.lit(0))).over(w)).withColumn("picked", F.sum(F.coalesce("n", F.lit(0))).over(w))
    scored = full.withColumn("f1", f1(F.col("tp"), F.col("picked") - F.col("tp"), F.col("all_pos") - F.col("tp"))).withColumn("threshold", t(F.col("step")))
    best = F.max(F.struct("f1", (-F.col("step")).alias("s"), "threshold"))
    return scored.groupBy(by).agg(best.alias("b")).select(by, F.col("b.threshold").alias("threshold"), F.col("b.f1").alias("f1"))


def curve_thresholds(df: DataFrame, label: str = "label", by: str = "class_id", prob: str = "prob") -> DataFrame:
    """The score with the best 2PR / (P + R + 1e-8) on the precision-recall curve, clipped; the smallest of equals.

    Counts above a score are two-level sums: over the BINS stretches of a class, then within a stretch, so that a class
    isn't sorted in one task.
    """
    score = F.col(prob).cast("double")
    place = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(score * BINS))).cast("int")
    stretch = F.when(F.isnan(score), BINS - 1).otherwise(F.coalesce(place, F.lit(-1)))
    counts = df.groupBy(by, F.col(prob).alias("threshold"), stretch.alias("bin")).agg(F.sum((F.col(label) > 0).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy(by, "bin").agg(F.sum("pos").alias("bin_pos"), F.sum("n").alias("bin_n"))
    before = Window.partitionBy(by).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = sums.select(F.col(by).alias("__by"), F.col("bin").alias("__bin"), over("bin_pos").alias("tp0"), over("bin_n").alias("n0"), F.sum("bin_pos").over(Window.partitionBy(by)).alias("all_pos"))
    w = Window.partitionBy(by, "bin").orderBy(F.desc("threshold"))
    curve = counts.withColumn("tp", F.sum("pos").over(w)).withColumn("picked", F.sum("n").over(w))
    curve = curve.join(sums, F.col(by).eqNullSafe(F.col("__by")) & (F.col("bin") == F.col("__bin")))
    curve = curve.withColumn("tp", F.col("tp") + F.col("tp0")).withColumn("picked", F.col("picked") + F.col("n0"))
    p, r = F.col("tp") / F.col("picked"), F.when(F.col("all_pos") > 0, F.col("tp") / F.col("all_pos")).otherwise(1.0)
    scored = curve.withColumn("score", 2 * p * r / (p + r + 1e-8))
    best = F.max(F.struct("score", (-F.col("threshold")).alias("t"))).alias("b")
    return scored.groupBy(by).agg(best).select(by, F.greatest(F.lit(LOW), F.least(F.lit(HIGH), -F.col("b.t"))).alias("threshold"))


def tuned_thresholds(df: DataFrame, label: str = "label", by: str = "class_id", prob: str = "prob") -> DataFrame:
    """0.5 for classes without positives, the curve's threshold for 1 to 9, the grid's for more; each way sees its classes only."""
    n = df.groupBy(by).agg(F.sum((F.col(label) > 0).cast("long")).alias("n_pos"))
    of = lambda which: df.join(n.where(which).select(by), by, "left_semi")
    few = curve_thresholds(of("n_pos between 1 and 9"), label, by, prob).withColumnRenamed("threshold", "few")
    many = grid_thresholds(of("n_pos >= 10"), label, by, prob).withColumnRenamed("threshold", "many").drop("f1")
    picked = F.when(F.col("n_pos") == 0, 0.5).when(F.col("n_pos") < 10, F.col("few")).otherwise(F.col("many"))
    return n.join(few, by, "left").join(many, by, "left").select(by, "n_pos", picked.alias("threshold"))


def apply_thresholds(df: DataFrame, thresholds: DataFrame, by: str = "class_id", prob: str = "prob") -> DataFrame:
    return df.join(thresholds.select(by, "threshold"), by).withColumn("predicted", (F.col(prob).cast("double") >= F.col("threshold")).cast("int"))


def fold_means(df: DataFrame, keys: list[str], prob: str = "prob") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(prob).alias(prob))
