"""Spark-first analytics operators over DataFrames."""
