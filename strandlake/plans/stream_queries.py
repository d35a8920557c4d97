"""Queries that run a stream over what there is and give its result as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.plans import interval_queries
from strandlake.plans.tables import table
from strandlake.session import Staged, shared_dir, stage
from strandlake.streaming.intervals import event_windows, growing_runs, latest_runs


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parquet*")


def _result(stream: DataFrame, mode: str) -> DataFrame:
    """The last batch in complete mode, all batches in update mode."""
    spark, where = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/streamed-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows" if mode == "complete" else f"{where}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return Staged(spark, f"{where}/rows").df


def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    g = _result(event_windows(_stream(spark, d, "events"), size="1 hour"), "complete")
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("w_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    g = _result(event_windows(_stream(spark, d, "events"), size="2 hours", slide="1 hour", keys=()), "complete")
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("w_start"), "n", F.round("total", 4).alias("total"))


def stream_growing_runs(spark: SparkSession, d: str) -> DataFrame:
    """The table comes as three files, one a batch."""
    parts = stage(table(spark, d, "narrow_peak").select("chrom", "start_pos", "end_pos").repartition(3), "arriving")
    stream = spark.readStream.schema(parts.df.schema).option("maxFilesPerTrigger", 1).parquet(parts.path)
    return latest_runs(_result(growing_runs(stream), "update"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_growing_runs)}
SQL = {
    "stream_growing_runs": interval_queries.SQL["merge_intervals"],
    "stream_tumbling": "select time_bucket(interval 1 hour, ts) w_start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2",
    "stream_sliding": """with e as (select *, unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) w_start from events)
        select w_start, count(*) n, round(sum(value), 4) total from e group by 1""",
}
