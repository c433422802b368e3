"""The monthly forecast from sensor rows: derived columns, rollup, device dimension, features, baseline, boosted trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import features
from quillspan.operators import models, rollup

KEYS = ["deviceId", "month_key", "period"]
TEMPERATURES = [f"t{i}" for i in range(1, 14)]
MEANS = ["x1", "x2", *TEMPERATURES, "hour_cos", "hour_sin", "delta_source", "delta_load"]
SPREADS = ["x2", "x1", "t1", "delta_source", "delta_load"]
#: What the trees are fitted on.
INPUTS = [
    "avg_temp", "temp_range", "x1", "distance_km", "month", "month_cos", "month_sin", "deviceType", "x3", "device_baseline", "latitude", "longitude",
    "delta_source", "delta_load", "hour_cos", "hour_sin", "x2_std", "x1_std", "t1_std", "delta_source_std", "delta_load_std", "load_ratio",
]


def derived(rows: DataFrame) -> DataFrame:
    """Sensor rows (timedate as text) with the hour's circle, the source and load differences and the month's key."""
    cos, sin = features.cyclic(features.hour_of("timedate"), 24)
    return rows.withColumns({"hour_cos": cos, "hour_sin": sin, "delta_source": F.col("t3") - F.col("t4"), "delta_load": F.col("t5") - F.col("t6"), "month_key": features.month_key("timedate")})


def monthly(rows: DataFrame) -> DataFrame:
    """A row for each device, month and period: means, deviations, first values; columns that the rows lack are left out."""
    return rollup.rollup(derived(rows), KEYS, MEANS, SPREADS, ["x3", "deviceType"])


def table_of(rows: DataFrame, devices: DataFrame, train: str = "train") -> DataFrame:
    """The monthly table with all INPUTS; the baseline is a device's mean target over the training months."""
    months = monthly(rows)
    full = features.telemetry_features(rollup.with_dimension(months, devices, "deviceId"), TEMPERATURES)
    return rollup.target_encode(months.where(F.col("period") == train), full, "deviceId", "x2", "device_baseline")


def fit(table: DataFrame, target: str = "x2", **options):
    """Boosted trees on the training months, stopped early by the valid ones."""
    ready = table.where(F.col("period").isin("train", "valid")).withColumn("__valid", F.col("period") == "valid")
    return models.gbt_regressor(ready, INPUTS, target, validation="__valid", **options)


def predictions(model, table: DataFrame, period: str = "test") -> DataFrame:
    """deviceId, year, month, prediction."""
    return models.predict(model, table.where(F.col("period") == period), INPUTS).select("deviceId", "year", "month", "prediction")
