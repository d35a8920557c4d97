"""Tables of a data folder, and columns that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns in which two rows of narrow_peak are one peak.
PEAK = ["chrom", "start_pos", "end_pos", "id", "score", "strand", "signalvalue", "pvalue", "qvalue", "peak"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usable(value: str) -> Column:
    """Not null, finite and at least 0."""
    v = F.col(value)
    return v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))
