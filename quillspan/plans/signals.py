"""Raster and signal queries: an embedding is an 8 x 8 image and a signal of 64 samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import raster, signal
from quillspan.plans.registry import query, table
from quillspan.streaming import rollup as streamed


def images(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("flat")).withColumn("image", raster.rows_of("flat", 8))


@query(
    """WITH s AS (SELECT vec_id, k, 1 / (1 + exp(-(embedding[k]::DOUBLE))) AS a, 1 / (1 + exp(-(embedding[((k - 1) // 8) * 8 + 8 - (k - 1) % 8]::DOUBLE * 0.5::DOUBLE))) AS b FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings))
SELECT vec_id, CAST(sum(((a + b) / 2 > 0.5)::INT) AS BIGINT) AS lit, round(sum((a + b) / 2), 5) AS total FROM s GROUP BY ALL"""
)
def img_flip_avg(spark, sf_dir):
    """Predictions of an image and of its mirror image (the latter half as sure), averaged and cut at 0.5."""
    i = images(spark, sf_dir)
    sure = F.transform("image", lambda r: F.transform(r, raster.sigmoid))
    mirrored = F.transform(raster.flip(F.col("image")), lambda r: F.transform(r, lambda x: raster.sigmoid(x * F.lit(0.5))))
    # the mirrored prediction is of the mirrored image; flip_average mirrors it back
    both = i.withColumn("p", raster.flip_average(sure, F.transform(mirrored, lambda r: F.reverse(r)))).withColumn("mask", F.flatten(raster.threshold_mask(F.col("p"), 0.5)))
    total = F.aggregate(F.flatten("p"), F.lit(0.0), lambda a, x: a + x)
    return both.select("vec_id", F.size(F.filter("mask", lambda x: x > 0)).cast("long").alias("lit"), F.round(total, 5).alias("total"))


@query("SELECT vec_id, y, x, round(embedding[(y * 8 // 12) * 8 + x * 8 // 20 + 1]::DOUBLE, 6) AS v FROM embeddings, range(0, 12) a(y), range(0, 20) b(x)")
def img_resize_nearest(spark, sf_dir):
    i = images(spark, sf_dir).select("vec_id", F.posexplode(raster.resize_nearest(F.col("image"), 12, 20)).alias("y", "row"))
    return i.select("vec_id", F.col("y").cast("long").alias("y"), F.posexplode("row").alias("x", "v")).select("vec_id", "y", F.col("x").cast("long").alias("x"), F.round("v", 6).alias("v"))


_LEADS = "leads(r, c, lead) AS (VALUES (0, 0, 'I'), (0, 1, 'AVR'), (0, 2, 'V1'), (0, 3, 'V4'), (1, 0, 'II'), (1, 1, 'AVL'), (1, 2, 'V2'), (1, 3, 'V5'), (2, 0, 'III'), (2, 1, 'AVF'), (2, 2, 'V3'), (2, 3, 'V6'))"


@query(f"WITH {_LEADS} SELECT vec_id, lead, 36::BIGINT AS height, 36::BIGINT AS width, round(embedding[((r * 40 + 2) // 20) * 8 + (c * 40 + 2) // 20 + 1]::DOUBLE, 6) AS corner FROM embeddings, leads")
def grid_slice(spark, sf_dir):
    """The image enlarged to 160 x 160: cells of 40, margins of 2."""
    big = images(spark, sf_dir).select("vec_id", raster.resize_nearest(F.col("image"), 160, 160).alias("big"))
    p = raster.lead_patches(big, "vec_id", "big")
    row = F.get("patch", F.lit(0))
    return p.select("vec_id", "lead", F.size("patch").cast("long").alias("height"), F.size(row).cast("long").alias("width"), F.round(F.get(row, F.lit(0)), 6).alias("corner"))


@query(
    """WITH p AS (SELECT vec_id, (k - 1) // 8 AS y, (k - 1) % 8 AS x FROM (SELECT *, unnest(range(1, 65)) AS k FROM embeddings) WHERE embedding[k] > 0.05), c AS (SELECT vec_id, x, 8 - (min(y) + max(y)) / 2.0::DOUBLE AS mid FROM p GROUP BY ALL)
SELECT vec_id, count(*) AS n_valid, min(x)::INTEGER AS first_x, max(x)::INTEGER AS last_x, sum(mid) AS total FROM c GROUP BY ALL"""
)
def column_envelope(spark, sf_dir):
    """Traces of 8 columns, so that at least one valid column is asked for."""
    lit = images(spark, sf_dir).withColumn("lit", F.transform("image", lambda r: F.transform(r, lambda x: x.cast("float"))))
    t = raster.trace(raster.column_envelope(lit, ["vec_id"], "lit", 0.05), ["vec_id"], least=1)
    return t.select("vec_id", "n_valid", "first_x", "last_x", F.aggregate("signal", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))).alias("total"))


@query("SELECT vec_id, 'V' || (vec_id % 6 + 1) AS lead, round(max((x - m) / (640 / 29.7::DOUBLE)), 6) AS top, round(min((x - m) / (640 / 29.7::DOUBLE)), 6) AS bottom FROM (SELECT vec_id, x, median(x) OVER (PARTITION BY vec_id) AS m FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)) GROUP BY ALL")
def center_mv(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("mv", signal.to_millivolts("embedding", F.lit(640)))
    lead = signal.lead_name(F.concat(F.lit("lead_v"), (F.col("vec_id") % 6 + 1).cast("string")))
    return e.select("vec_id", lead.alias("lead"), F.round(F.array_max("mv"), 6).alias("top"), F.round(F.array_min("mv"), 6).alias("bottom"))


@query(
    """SELECT vec_id, i, round(a + (pos - lo) * (b - a), 6) AS v FROM (SELECT vec_id, i, pos, floor(pos) AS lo, embedding[floor(pos)::INT + 1]::DOUBLE AS a, embedding[least(floor(pos)::INT + 1, 63) + 1]::DOUBLE AS b
FROM (SELECT *, i * 63 / 24.0::DOUBLE AS pos FROM embeddings, range(0, 25) t(i)))"""
)
def resample_linear(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.resample("embedding", 25)).alias("i", "v"))
    return e.select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


def _smoothed(name: str, function, doc: str):
    def run(spark, sf_dir):
        @F.pandas_udf("array<double>")
        def apply(x: pd.Series) -> pd.Series:
            return pd.Series([v.tolist() for v in function([np.asarray([] if v is None else v, float) for v in x])], dtype=object)

        e = table(spark, sf_dir, "embeddings").select("vec_id", apply(F.col("embedding").cast("array<double>")).alias("y"))
        return e.select("vec_id", F.posexplode("y").alias("i", "v")).withColumn("v", F.round("v", 6))

    run.__name__, run.__doc__ = name, doc
    return query()(run)


signal_baseline_als = _smoothed("signal_baseline_als", lambda xs: signal.by_length(xs, lambda m: m - signal.als_baseline(m)), "Signals less their asymmetric least squares baseline.")
savgol = _smoothed("savgol", lambda xs: map(signal.savgol, xs), "Signals smoothed by cubics over seven samples.")
pchip_fill = _smoothed("pchip_fill", lambda xs: (signal.pchip_fill(np.where(x > -0.1, x, np.nan)) for x in xs), "Samples below -0.1 filled by monotone cubics.")


@query("SELECT time_bucket(INTERVAL '1 day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def events_daily(spark, sf_dir):
    """The streaming rollup's aggregate in batch."""
    df = streamed.windowed(table(spark, sf_dir, "events"), "ts", ["event_type"], "value")
    return df.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("sum", 3).alias("total"))
