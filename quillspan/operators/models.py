"""Models by pyspark.ml, features by pluggable functions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Featurise = Callable[[pd.Series], pd.Series]


def gram_counts(c: str, n: int = 3, bins: int = 256) -> Column:
    """Hashed character n-gram counts as array<double>: the default in place of chemical fingerprints."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.pmod(F.xxhash64(F.substring(F.col(c), i, F.lit(n))), F.lit(bins)))
    counts = F.aggregate(grams, F.create_map().cast("map<bigint,double>"), lambda m, g: F.map_concat(F.map_filter(m, lambda k, v: k != g), F.create_map(g, F.coalesce(F.try_element_at(m, g), F.lit(0.0)) + 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at(counts, b.cast("long")), F.lit(0.0)))


def featurised(df: DataFrame, source: str, name: str, function: Featurise) -> DataFrame:
    """Adds array<double> features by a vectorised function from strings to lists, such as a fingerprint library's."""
    return df.withColumn(name, F.pandas_udf(function, T.ArrayType(T.DoubleType()))(source))


def scaffold_key(df: DataFrame, smiles: str, name: str = "scaffold", function: Featurise | None = None) -> DataFrame:
    """A group key: by a library's function where given, else the string without brackets' contents and branches."""
    if function is not None:
        return df.withColumn(name, F.coalesce(F.pandas_udf(function, T.StringType())(smiles), F.col(smiles)))
    bare = F.regexp_replace(F.regexp_replace(F.col(smiles), r"\([^()]*\)", ""), r"\[[^\]]*\]", "*")
    return df.withColumn(name, F.when(bare != "", bare).otherwise(F.col(smiles)))


def gbt_regressor(train: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 5, rate: float = 0.1, subsample: float = 0.85, validation: str | None = None, seed: int = 42):
    """A fitted pipeline of assembler and boosted trees; validation: a boolean column for early stopping."""
    from pyspark.ml import Pipeline

    gbt = GBTRegressor(labelCol=label, featuresCol="__features", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    filled = train.na.fill(0.0, features)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__features"), gbt]).fit(filled)


def predict(model, df: DataFrame, features: list[str], name: str = "prediction") -> DataFrame:
    out = model.transform(df.na.fill(0.0, features)).drop("__features")
    return out.withColumnRenamed("prediction", name) if name != "prediction" else out


def gbt_per_class(wide: DataFrame, features: str, classes: list[str], rounds: int = 10, depth: int = 3, rate: float = 0.1, subsample: float = 0.8, seed: int = 42) -> dict:
    """A booster for each class column, positives weighted by n_neg / max(n_pos, 1); classes of one value have none."""
    from pyspark.ml.functions import array_to_vector

    ready = wide.withColumn("__features", array_to_vector(F.col(features).cast("array<double>"))).cache()
    sums = ready.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(c).cast("double")).alias(c) for c in classes)).first()
    models = {}
    for c in classes:
        pos, n = sums[c] or 0.0, sums["n"]
        if 0 < pos < n:
            weighted = ready.withColumn("__y", F.col(c).cast("double")).withColumn("__w", F.when(F.col(c) > 0, (n - pos) / max(pos, 1.0)).otherwise(1.0))
            models[c] = GBTClassifier(labelCol="__y", featuresCol="__features", weightCol="__w", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed).fit(weighted)
    ready.unpersist()
    return models


def class_probabilities(models: dict, wide: DataFrame, features: str, key: str, classes: list[str]) -> DataFrame:
    """Long table (key, class_id, prob); classes without a model have 0."""
    from pyspark.ml.functions import array_to_vector

    out = wide.select(key, array_to_vector(F.col(features).cast("array<double>")).alias("__features"))
    made: dict = {}
    for c in classes:  # all in one pass over the rows
        made[c] = F.lit(0.0)
        if c in models:
            names = {"rawPredictionCol": f"__raw_{c}", "probabilityCol": f"__p_{c}", "predictionCol": f"__y_{c}"}
            out = models[c].copy({models[c].getParam(k): v for k, v in names.items()}).transform(out).drop(names["rawPredictionCol"], names["predictionCol"])
            made[c] = F.get(vector_to_array(f"__p_{c}"), F.lit(1))
    rows = F.array(*(F.struct(F.lit(c).alias("class_id"), p.alias("prob")) for c, p in made.items()))
    return out.select(key, F.explode(rows).alias("__r")).select(key, "__r.class_id", "__r.prob")


def save(model, path: str, mode: str = "overwrite") -> None:
    """A fitted pipeline or model, or a dictionary of them, each under its name in a folder of its own."""
    if isinstance(model, dict):
        for name, each in model.items():
            save(each, f"{path}/{name}", mode)
        return
    writer = model.write().overwrite() if mode == "overwrite" else model.write()
    writer.save(path)


def load(path: str, names: list[str] | None = None):
    """What save() wrote: a fitted pipeline, or the models of `names`, as a dictionary."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassificationModel

    return PipelineModel.load(path) if names is None else {n: GBTClassificationModel.load(f"{path}/{n}") for n in names}


def batch_predictor(make_predict, shape: list[int], result: str = "array<float>", batch: int = 64):
    """A column function over batches of arrays; make_predict() loads the network once for each worker and returns a function of a batch of tensors of the shape."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import _parse_datatype_string

    return predict_batch_udf(make_predict, return_type=_parse_datatype_string(result), batch_size=batch, input_tensor_shapes=[shape])
