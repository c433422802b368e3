"""Session settings shared by the bench, the tests and applications."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "quillspan", cpus: int = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session; on a cluster pass a session made by spark-submit to the operators instead."""
    root = str(Path(__file__).resolve().parent.parent)
    seen = os.environ.get("PYTHONPATH", "")
    if root not in seen.split(":"):
        os.environ["PYTHONPATH"] = f"{root}:{seen}" if seen else root
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
