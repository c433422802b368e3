"""Class hierarchies: closure, hard and soft propagation, inconsistencies.

Edges are (child, parent) and must be acyclic; a cycle raises. Tables of edges are small beside the long label and
probability tables that they are joined to, and Spark picks the join by their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(node, ancestor) pairs, every node with itself too, by a fixpoint of joins.

    New pairs only are joined in each round. Where a checkpoint folder is set, lineage is cut by checkpoint() once in a
    few rounds and at the end, and nothing stays cached.
    """
    spark = edges.sparkSession
    edges = edges.select("child", "parent").distinct().cache()
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty() and (folder := spark.conf.get("spark.checkpoint.dir", None)):
        spark.sparkContext.setCheckpointDir(folder)
    can_cut = spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    total = nodes.select("node", F.col("node").alias("ancestor"))
    new, depth, cached = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")), 0, [edges]
    limit = nodes.count()
    while not new.isEmpty():
        depth += 1
        if depth > min(limit, max_depth):
            raise ValueError("the hierarchy has a cycle")
        total = total.union(new).distinct()
        if can_cut and depth % 4 == 0:
            total = total.checkpoint()
        step = new.join(edges, new.ancestor == edges.child).select("node", F.col("parent").alias("ancestor")).distinct()
        new = step.cache()
        cached.append(new)
    total = total.distinct()
    if can_cut:
        total = total.checkpoint()
    if not total.join(edges, (total.ancestor == edges.child) & (total.node == edges.parent)).isEmpty():
        raise ValueError("the hierarchy has a cycle")
    if can_cut:
        for df in cached:
            df.unpersist()
    return total


def hard_propagate(labels: DataFrame, pairs: DataFrame, key: str, node: str = "class_id", label: str = "label", columns: DataFrame | None = None) -> DataFrame:
    """An ancestor's label is 1 if any descendant's is; paths may run through classes that have no column.

    columns: classes (column `node`) to return, all by default.
    """
    up = labels.join(pairs, labels[node] == pairs.node).groupBy(key, "ancestor").agg(F.max(label).alias(label))
    up = up.select(key, F.col("ancestor").alias(node), label)
    return up.join(columns.select(F.col("node").alias(node)), node, "left_semi") if columns is not None else up


def soft_propagate(probs: DataFrame, edges: DataFrame, key: str, node: str = "class_id", prob: str = "prob") -> DataFrame:
    """p'(c) = the least probability of c and its ancestors, along edges between present classes only.

    That is the top-down pass in closed form; a bottom-up pass with max changes nothing after it on a DAG.
    """
    present = probs.select(F.col(node).alias("__n")).distinct()
    inner = edges.join(present, F.col("child") == F.col("__n"), "left_semi").join(present, F.col("parent") == F.col("__n"), "left_semi")
    pairs = closure(inner)
    own = present.select(F.col("__n").alias("node"), F.col("__n").alias("ancestor"))
    pairs = pairs.union(own).distinct()
    values = probs.select(F.col(key), F.col(node).alias("ancestor"), F.col(prob).alias("__p"))
    return values.join(pairs, "ancestor").groupBy(key, F.col("node").alias(node)).agg(F.min("__p").alias(prob))


def inconsistencies(probs: DataFrame, edges: DataFrame, key: str, node: str = "class_id", prob: str = "prob") -> DataFrame:
    """How often a child's probability is over its parent's, over direct edges."""
    child = probs.select(F.col(key).alias("k"), F.col(node).alias("child"), F.col(prob).alias("pc"))
    parent = probs.select(F.col(key).alias("k"), F.col(node).alias("parent"), F.col(prob).alias("pp"))
    both = child.join(edges, "child").join(parent, ["k", "parent"])
    return both.agg(F.count(F.lit(1)).alias("n_pairs"), F.coalesce(F.sum((F.col("pc") > F.col("pp")).cast("long")), F.lit(0)).alias("n_inconsistent"))
