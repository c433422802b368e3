"""Telemetry queries: lineitem stands for sensor rows, supplier and nation for the device dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import features
from quillspan.operators import forecast, rollup
from quillspan.plans.registry import query, table

KEYS = ["deviceId", "month_key", "period"]


def facts(spark, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    return x.select(
        F.col("l_suppkey").alias("deviceId"), features.month_key("l_shipdate").alias("month_key"),
        F.when(year < 1996, "train").when(year == 1996, "valid").otherwise("test").alias("period"),
        F.col("l_quantity").alias("x1"), F.col("l_extendedprice").alias("x2"), (F.col("l_suppkey") % 3).cast("double").alias("deviceType"), (F.col("l_suppkey") % 7 + 0.5).cast("double").alias("x3"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 100).alias("t1"), (F.col("l_tax") * 100).alias("t2"), F.col("l_quantity").alias("t3"), F.col("l_linenumber").cast("double").alias("t4"),
    )


def monthly(spark, sf_dir: str) -> DataFrame:
    rows = facts(spark, sf_dir).withColumn("t34", F.col("t3") - F.col("t4"))
    return rollup.rollup(rows, KEYS, ["x1", "x2", "t1", "t2", "t3", "t4", "t34"], ["x2"], ["deviceType", "x3"])


def devices(spark, sf_dir: str) -> DataFrame:
    lat, lon = 40 + F.col("s_nationkey") * 0.5, 10 + F.col("s_nationkey") * 0.75
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("deviceId"), lat.cast("double").alias("latitude"), lon.cast("double").alias("longitude"))


FACTS = """
WITH facts AS (
  SELECT l_suppkey AS deviceId, CAST(year(l_shipdate) AS VARCHAR) || '_' || CAST(month(l_shipdate) AS VARCHAR) AS month_key,
    CASE WHEN year(l_shipdate) < 1996 THEN 'train' WHEN year(l_shipdate) = 1996 THEN 'valid' ELSE 'test' END AS period,
    l_quantity AS x1, l_extendedprice AS x2, CAST(l_suppkey % 3 AS DOUBLE) AS deviceType, CAST(l_suppkey % 7 + 0.5 AS DOUBLE) AS x3,
    CASE WHEN l_linenumber <> 3 THEN l_discount * 100 END AS t1, l_tax * 100 AS t2, l_quantity AS t3, CAST(l_linenumber AS DOUBLE) AS t4
  FROM lineitem
), monthly AS (
  SELECT deviceId, month_key, period, count(*) AS n_rows, coalesce(sum(x1), 0) / count(*) AS x1, coalesce(sum(x2), 0) / count(*) AS x2,
    coalesce(sum(t1), 0) / count(*) AS t1, coalesce(sum(t2), 0) / count(*) AS t2, coalesce(sum(t3), 0) / count(*) AS t3, coalesce(sum(t4), 0) / count(*) AS t4,
    coalesce(sum(t3 - t4), 0) / count(*) AS t34,
    sqrt(greatest(sum(x2 * x2) / count(*) - (sum(x2) / count(*)) * (sum(x2) / count(*)), 0)) AS x2_std, min(deviceType) AS deviceType, min(x3) AS x3
  FROM facts GROUP BY ALL
), devices AS (
  SELECT s_suppkey AS deviceId, (40 + s_nationkey * 0.5)::DOUBLE AS latitude, (10 + s_nationkey * 0.75)::DOUBLE AS longitude FROM supplier
)
"""


SHIFT = 1e-7


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """The SHIFT keeps exact ties, where sums in another order differ, off the rounding bound; the SQL has it too."""
    return df.withColumns({c: F.round(F.col(c) + SHIFT, digits) for c in columns})


@query(FACTS + "SELECT deviceId, month_key, period, n_rows, round(x1 + 1e-7::DOUBLE, 4) AS x1, round(x2 + 1e-7::DOUBLE, 3) AS x2, round(t34 + 1e-7::DOUBLE, 4) AS t34, round(x2_std + 1e-7::DOUBLE, 1) AS x2_std, deviceType FROM monthly")
def rollup_monthly(spark, sf_dir):
    df = monthly(spark, sf_dir).select(*KEYS, "n_rows", "x1", "x2", "t34", "x2_std", "deviceType")
    return rounded(rounded(rounded(df, 4, "x1", "t34"), 3, "x2"), 1, "x2_std")


@query(FACTS + "SELECT deviceId, month_key, period, round(t1 + 1e-7::DOUBLE, 4) AS t1 FROM monthly")
def rollup_null_bias(spark, sf_dir):
    return rounded(monthly(spark, sf_dir).select(*KEYS, "t1"), 4, "t1")


@query(FACTS + "SELECT deviceId, month_key, period, deviceType, round(x1 + 1e-7::DOUBLE, 4) AS x1, latitude, longitude FROM monthly LEFT JOIN devices USING (deviceId)")
def rollup_joined(spark, sf_dir):
    df = rollup.with_dimension(monthly(spark, sf_dir), devices(spark, sf_dir), "deviceId")
    return rounded(df.select(*KEYS, "deviceType", "x1", "latitude", "longitude"), 4, "x1")


@query(FACTS + """
, f AS (SELECT m.*, latitude, longitude, CAST(split_part(month_key, '_', 1) AS INTEGER) AS year, CAST(split_part(month_key, '_', 2) AS INTEGER) AS month,
  (t1 + t2 + t3 + t4) / 4 AS avg_temp FROM monthly m LEFT JOIN devices USING (deviceId))
SELECT deviceId, month_key, period, year, month, round(cos(2 * pi() * month / 12) + 1e-7::DOUBLE, 6) AS month_cos, round(sin(2 * pi() * month / 12) + 1e-7::DOUBLE, 6) AS month_sin,
  round(avg_temp + 1e-7::DOUBLE, 4) AS avg_temp, round(greatest(t1, t2, t3, t4) - least(t1, t2, t3, t4) + 1e-7::DOUBLE, 4) AS temp_range,
  round(6371 * acos(greatest(least(sin(radians(latitude)) * sin(0.9115::DOUBLE) + cos(radians(latitude)) * cos(0.9115::DOUBLE) * cos(radians(longitude) - 0.3665::DOUBLE), 1), -1)) + 1e-7::DOUBLE, 3) AS distance_km,
  round(x1 / greatest(t1 - avg_temp, 1e-6::DOUBLE) + 1e-7::DOUBLE, 1) AS load_ratio, deviceType || '_' || month AS device_month, x3 || '_' || month AS curve_month FROM f
""")
def telemetry_features(spark, sf_dir):
    joined = rollup.with_dimension(monthly(spark, sf_dir), devices(spark, sf_dir), "deviceId")
    df = features.telemetry_features(joined, [f"t{i}" for i in range(1, 14)])
    df = df.select(*KEYS, "year", "month", "month_cos", "month_sin", "avg_temp", "temp_range", "distance_km", "load_ratio", "device_month", "curve_month")
    return rounded(rounded(rounded(rounded(df, 6, "month_cos", "month_sin"), 4, "avg_temp", "temp_range"), 3, "distance_km"), 1, "load_ratio")


ENCODED = ", enc AS (SELECT deviceId, avg(x2) AS baseline FROM monthly WHERE period = 'train' GROUP BY ALL)"


def encoded(spark, sf_dir):
    m = monthly(spark, sf_dir)
    return rollup.target_encode(m.where("period = 'train'"), m.where("period <> 'train'"), "deviceId", "x2", "device_baseline")


@query(FACTS + ENCODED + "SELECT deviceId, month_key, period, round(coalesce(baseline, 0) + 1e-7::DOUBLE, 3) AS device_baseline FROM monthly LEFT JOIN enc USING (deviceId) WHERE period <> 'train'")
def target_encoding(spark, sf_dir):
    return rounded(encoded(spark, sf_dir).select(*KEYS, "device_baseline"), 3, "device_baseline")


@query(FACTS + "SELECT period, count(*) AS n_rows, count(DISTINCT deviceId) AS n_devices FROM monthly GROUP BY ALL")
def split_counts(spark, sf_dir):
    return monthly(spark, sf_dir).groupBy("period").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("deviceId").alias("n_devices"))


@query(FACTS + ENCODED + "SELECT round(avg(abs(x2 - coalesce(baseline, 0))) + 1e-7::DOUBLE, 3) AS mae, count(*) AS n FROM monthly LEFT JOIN enc USING (deviceId) WHERE period = 'valid'")
def mae_baseline(spark, sf_dir):
    return rounded(rollup.mean_absolute_error(encoded(spark, sf_dir).where("period = 'valid'"), "x2", "device_baseline"), 3, "mae")


@query(FACTS + ENCODED + "SELECT deviceId, CAST(split_part(month_key, '_', 1) AS INTEGER) AS year, CAST(split_part(month_key, '_', 2) AS INTEGER) AS month, round(coalesce(baseline, 0) + 1e-7::DOUBLE, 3) AS prediction FROM monthly LEFT JOIN enc USING (deviceId) WHERE period = 'test' ORDER BY 1, 2, 3")
def submission_sorted(spark, sf_dir):
    year, month = features.split_month("month_key")
    df = encoded(spark, sf_dir).where("period = 'test'").select("deviceId", year.alias("year"), month.alias("month"), F.round(F.col("device_baseline") + SHIFT, 3).alias("prediction"))
    return df.orderBy("deviceId", "year", "month")


@query("SELECT hour(ts)::DOUBLE AS hour, round(cos(2 * pi() * hour(ts) / 24) + 1e-7::DOUBLE, 6) AS hour_cos, round(sin(2 * pi() * hour(ts) / 24) + 1e-7::DOUBLE, 6) AS hour_sin, event_type, count(*) AS n, round(sum(value) + 1e-7::DOUBLE, 3) AS total FROM events GROUP BY ALL")
def hourly_cyclic(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("text", F.col("ts").cast("string")).withColumn("hour", features.hour_of("text"))
    cos, sin = features.cyclic(F.col("hour"), 24)
    df = df.groupBy("hour", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value") + SHIFT, 3).alias("total"))
    return df.select("hour", F.round(cos + SHIFT, 6).alias("hour_cos"), F.round(sin + SHIFT, 6).alias("hour_sin"), "event_type", "n", "total")


def sensors(spark, sf_dir: str) -> DataFrame:
    """facts() with what the whole forecast needs besides: a time of day and two more temperatures."""
    x = table(spark, sf_dir, "lineitem")
    year = F.year("l_shipdate")
    hour = F.lpad((F.col("l_orderkey") % 24).cast("string"), 2, "0")
    return x.select(
        F.col("l_suppkey").alias("deviceId"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd "), hour, F.lit(":00")).alias("timedate"),
        F.when(year < 1996, "train").when(year == 1996, "valid").otherwise("test").alias("period"),
        F.col("l_quantity").alias("x1"), F.col("l_extendedprice").alias("x2"), (F.col("l_suppkey") % 3).cast("double").alias("deviceType"), (F.col("l_suppkey") % 7 + 0.5).cast("double").alias("x3"),
        F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 100).alias("t1"), (F.col("l_tax") * 100).alias("t2"), F.col("l_quantity").alias("t3"), F.col("l_linenumber").cast("double").alias("t4"),
        (F.col("l_discount") * 50).alias("t5"), (F.col("l_tax") * 20).alias("t6"),
    )


def _mean(x: str) -> str:
    return f"coalesce(sum({x}), 0) / count(*)"


def _std(x: str) -> str:
    return f"sqrt(greatest(sum(({x}) * ({x})) / count(*) - ({_mean(x)}) * ({_mean(x)}), 0))"


SENSORS = f"""
WITH rows AS (
  SELECT l_suppkey AS deviceId, CAST(year(l_shipdate) AS VARCHAR) || '_' || CAST(month(l_shipdate) AS VARCHAR) AS month_key, CAST(l_orderkey % 24 AS DOUBLE) AS hour,
    CASE WHEN year(l_shipdate) < 1996 THEN 'train' WHEN year(l_shipdate) = 1996 THEN 'valid' ELSE 'test' END AS period, l_quantity AS x1, l_extendedprice AS x2,
    CAST(l_suppkey % 3 AS DOUBLE) AS deviceType, CAST(l_suppkey % 7 + 0.5 AS DOUBLE) AS x3, CASE WHEN l_linenumber <> 3 THEN l_discount * 100 END AS t1, l_tax * 100 AS t2, l_quantity AS t3,
    CAST(l_linenumber AS DOUBLE) AS t4, l_discount * 50 AS t5, l_tax * 20 AS t6
  FROM lineitem
), monthly AS (
  SELECT deviceId, month_key, period, {", ".join(f"{_mean(c)} AS {c}" for c in ("x1", "x2", "t1", "t2", "t3", "t4", "t5", "t6"))}, {_mean("cos(2 * pi() * hour / 24)")} AS hour_cos, {_mean("sin(2 * pi() * hour / 24)")} AS hour_sin,
    {_mean("t3 - t4")} AS delta_source, {_mean("t5 - t6")} AS delta_load, {_std("x2")} AS x2_std, {_std("x1")} AS x1_std, {_std("t1")} AS t1_std, {_std("t3 - t4")} AS delta_source_std, {_std("t5 - t6")} AS delta_load_std,
    min(deviceType) AS deviceType, min(x3) AS x3 FROM rows GROUP BY ALL
), base AS (SELECT deviceId, avg(x2) AS device_baseline FROM monthly WHERE period = 'train' GROUP BY ALL),
f AS (
  SELECT m.* EXCLUDE (month_key), month_key, (40 + s_nationkey * 0.5)::DOUBLE AS latitude, (10 + s_nationkey * 0.75)::DOUBLE AS longitude, coalesce(device_baseline, 0) AS device_baseline,
    CAST(split_part(month_key, '_', 2) AS INTEGER) AS month, (t1 + t2 + t3 + t4 + t5 + t6) / 6 AS avg_temp, greatest(t1, t2, t3, t4, t5, t6) - least(t1, t2, t3, t4, t5, t6) AS temp_range
  FROM monthly m LEFT JOIN supplier ON deviceId = s_suppkey LEFT JOIN base USING (deviceId)
), g AS (
  SELECT *, cos(2 * pi() * month / 12) AS month_cos, sin(2 * pi() * month / 12) AS month_sin, x1 / greatest(t1 - avg_temp, 1e-6::DOUBLE) AS load_ratio,
    6371 * acos(greatest(least(sin(radians(latitude)) * sin(0.9115::DOUBLE) + cos(radians(latitude)) * cos(0.9115::DOUBLE) * cos(radians(longitude) - 0.3665::DOUBLE), 1), -1)) AS distance_km FROM f
)
"""
#: Places that sums in another order agree to.
PLACES = {"load_ratio": 1, "distance_km": 3, "device_baseline": 3, "x2_std": 3, "month": 0}


def _shown(c: str) -> str:
    return "month" if c == "month" else f"round({c} + 1e-7::DOUBLE, {PLACES.get(c, 4)}) AS {c}"


@query(SENSORS + f"SELECT deviceId, month_key, period, {', '.join(map(_shown, forecast.INPUTS))} FROM g")
def forecast_features(spark, sf_dir):
    """All inputs of the forecast, for every device and month."""
    df = forecast.table_of(sensors(spark, sf_dir), devices(spark, sf_dir)).select(*KEYS, *forecast.INPUTS)
    for c in forecast.INPUTS:
        df = df if c == "month" else rounded(df, PLACES.get(c, 4), c)
    return df


@query()
def gbt_regress(spark, sf_dir):
    """Boosted trees on all inputs of the monthly table, stopped early by the valid months."""
    whole = forecast.table_of(sensors(spark, sf_dir), devices(spark, sf_dir))
    return forecast.predictions(forecast.fit(whole), whole)
