"""Intervals that arrive over time: parsed as they come, merged into runs that grow."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandlake.operators.ranges import merge
from strandlake.session import shared_dir
from strandlake.sources.text import parse_intervals

_BIN = 1 << 20


def stream_intervals(spark: SparkSession, folder: str, **layout) -> DataFrame:
    """Good rows of interval files that are put into a folder."""
    return parse_intervals(spark.readStream.text(folder), **layout).where("error is null").drop("error")


def _join_runs(runs: list[list[int]], new: list[list[int]], max_dist: int) -> list[list[int]]:
    """All runs after new intervals came."""
    out: list[list[int]] = []
    for s, e in sorted(runs + new):
        if out and s <= out[-1][1] + max_dist:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def growing_runs(intervals: DataFrame, max_dist: int = 0) -> DataFrame:
    """chrom, bin, version, starts, ends: the runs of every range of positions that has changed (update mode).

    The state of a key is its runs within a range of 2^20 positions, so a chrom of any size is spread
    over many keys. A run may take back others that came out before, so a key's rows have versions and
    only the last one holds; ``latest_runs`` reads them and joins runs that cross a range's end.
    """
    rows = intervals.where("chrom is not null and start_pos < end_pos").select("chrom", "start_pos", "end_pos")
    cut = rows.withColumn("bin", F.explode(F.sequence(F.expr(f"start_pos div {_BIN}"), F.expr(f"(end_pos - 1) div {_BIN}"))))
    part = cut.select(
        "chrom", "bin", F.greatest("start_pos", F.col("bin") * _BIN).alias("start_pos"), F.least("end_pos", (F.col("bin") + 1) * _BIN).alias("end_pos")
    )

    def add(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, version = json.loads(state.get[0]) if state.exists else ([], 0)
        new = [r for b in batches for r in b[["start_pos", "end_pos"]].to_numpy().tolist()]
        joined = _join_runs([list(r) for r in runs], new, max_dist)
        if joined != runs:
            state.update((json.dumps([joined, version + 1]),))
            starts, ends = ([r[i] for r in joined] for i in (0, 1))
            yield pd.DataFrame({"chrom": [key[0]], "bin": [key[1]], "version": [version + 1], "starts": [starts], "ends": [ends]})

    return part.groupBy("chrom", "bin").applyInPandasWithState(
        add, "chrom string, bin bigint, version bigint, starts array<bigint>, ends array<bigint>", "runs string", "update", GroupStateTimeout.NoTimeout
    )


def latest_runs(versions: DataFrame, max_dist: int = 0) -> DataFrame:
    """chrom, start_pos, end_pos of the runs that hold, from all rows ``growing_runs`` has given so far."""
    last = versions.groupBy("chrom", "bin").agg(F.max_by(F.arrays_zip("starts", "ends"), "version").alias("x"))
    return merge(last.select("chrom", F.inline("x")).withColumnsRenamed({"starts": "start_pos", "ends": "end_pos"}), max_dist)


def event_windows(events: DataFrame, *, size: str, slide: str | None = None, late: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Count and sum by window and keys; rows later than ``late`` are left out."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, size, slide), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def event_sessions(events: DataFrame, *, gap: str, late: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def unique_events(events: DataFrame, *, key: str, late: str = "1 hour", time: str = "ts") -> DataFrame:
    """The first of the rows of a key within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_pipeline(source: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, name: str) -> None:
    """Reads what there is, sends each batch through a step and appends it to a Parquet table; a restart goes on where it stopped."""

    def put(batch: DataFrame, number: int) -> None:
        # A repeated batch replaces its own folder.
        step(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    state = f"{shared_dir(source.sparkSession)}/stream-{name}"
    source.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
