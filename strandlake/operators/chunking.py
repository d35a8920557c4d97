"""Per-key work in equal chunks, so that a few large keys do not decide the running time.

Exact offset chunking: keys are counted per input partition, the counts' prefix sums give each
partition its offset within the key, rows are numbered from there, equal runs of numbers form the
chunks, and the chunks' states are merged in order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from strandlake.session import Staged, null_safe, small_side, stage

ROW, PART, RANK, CHUNK = "_sl_row", "_sl_part", "_sl_rank", "_sl_chunk"


class Numbered:
    """Rows of a table with their number within their key (``_sl_rank``, from 0)."""

    def __init__(self, rows: Staged, offsets: Staged, keys: list[str]):
        self.rows, self.offsets, self.keys = rows, offsets, keys
        self.n_offsets = offsets.df.count()

    @property
    def df(self) -> DataFrame:
        rows = self.rows.df.withColumn(PART, F.shiftright(ROW, 33))
        cond, side = null_safe(rows, self.offsets.df, [*self.keys, PART])
        joined = rows.join(small_side(side, self.n_offsets), cond)
        kept = [c for c in rows.columns if c not in (ROW, PART)]
        return joined.select(*kept, (F.col("_sl_offset") + F.col(ROW) - F.col("_sl_first")).alias(RANK))

    def chunks(self, chunk_rows: int) -> DataFrame:
        """The rows with their chunk (``_sl_chunk``): equal runs of numbers within the key.

        A key of up to ``chunk_rows`` rows is one chunk, so only the offsets of larger keys are joined.
        """
        large = self.offsets.df.where(F.col("_sl_total") > chunk_rows)
        rows = self.rows.df.withColumn(PART, F.shiftright(ROW, 33))
        cond, side = null_safe(rows, large, [*self.keys, PART])
        joined = rows.join(small_side(side, large.count()), cond, "left")
        chunk = F.expr(f"(_sl_offset + {ROW} - _sl_first) div {int(chunk_rows)}")
        kept = [c for c in rows.columns if c not in (ROW, PART)]
        return joined.select(*kept, F.coalesce(chunk, F.lit(0)).alias(CHUNK))

    def sizes(self) -> DataFrame:
        return self.offsets.df.groupBy(*self.keys).agg(F.sum("_sl_n").alias("n_rows"))

    def drop(self) -> None:
        self.rows.drop()
        self.offsets.drop()


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> Numbered:
    """Numbers the rows of every key without bringing a key's rows together.

    No shuffle of rows: each input partition is sorted by key and written once; only one count per
    (key, partition) is exchanged. ``order`` sorts rows within an input partition; across partitions
    the partition order holds. Null is a key of its own. An empty table gives no rows.
    """
    keys = list(keys)
    rows = stage(
        df.sortWithinPartitions(*keys, *order).withColumn(ROW, F.monotonically_increasing_id()), "numbered"
    )
    per_part = (
        rows.df.withColumn(PART, F.shiftright(ROW, 33))
        .groupBy(*keys, PART)
        .agg(F.min(ROW).alias("_sl_first"), F.count("*").alias("_sl_n"))
    )
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counted = {"_sl_offset": F.coalesce(F.sum("_sl_n").over(before), F.lit(0)), "_sl_total": F.sum("_sl_n").over(Window.partitionBy(*keys))}
    offsets = stage(per_part.withColumns(counted), "offsets")
    return Numbered(rows, offsets, keys)


def key_totals(
    df: DataFrame,
    keys: Sequence[str],
    *,
    sums: Sequence[str] = (),
    lows: Sequence[str] = (),
    highs: Sequence[str] = (),
    ends: Sequence[str] = (),
    order: str | None = None,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Count, sums, extents and first/last values of every key.

    ``n_rows``, ``sum_<c>``, ``min_<c>``, ``max_<c>``; for each column of ``ends`` its value in the
    key's first and last row by ``order`` (``first_<c>``, ``last_<c>``; among equal order values, the
    smallest and the largest value). Nulls are skipped as in SQL, also in ``order``; a null key is a
    key. No rows give no keys. Columns of the input that are not named are not read.
    """
    need = list(dict.fromkeys([*keys, *sums, *lows, *highs, *ends, *([order] if order else [])]))
    numbered = number_rows(df.select(*need), keys)
    rows = numbered.chunks(chunk_rows)
    partial = [F.count("*").alias("n_rows")]
    partial += [F.sum(c).alias(f"sum_{c}") for c in sums]
    partial += [F.min(c).alias(f"min_{c}") for c in lows] + [F.max(c).alias(f"max_{c}") for c in highs]
    merged = [F.sum("n_rows").alias("n_rows")] + [F.sum(f"sum_{c}").alias(f"sum_{c}") for c in sums]
    merged += [F.min(f"min_{c}").alias(f"min_{c}") for c in lows] + [F.max(f"max_{c}").alias(f"max_{c}") for c in highs]
    if ends:
        partial += [F.min(order).alias("_sl_lo"), F.max(order).alias("_sl_hi")]
        for c in ends:
            # Boundary states of a chunk: the values at its lowest and highest order value.
            partial += [F.min(F.when(F.col(order).isNotNull(), F.struct(order, c))).alias(f"_sl_first_{c}")]
            partial += [F.max(F.when(F.col(order).isNotNull(), F.struct(order, c))).alias(f"_sl_last_{c}")]
            merged += [F.min(f"_sl_first_{c}")[c].alias(f"first_{c}"), F.max(f"_sl_last_{c}")[c].alias(f"last_{c}")]
    return rows.groupBy(*keys, CHUNK).agg(*partial).groupBy(*keys).agg(*merged)


def _carried(keys: list[str], values: list[str], names: list[str]):
    """Row numbers and running sums within the key, of a sorted partition, from its beginning."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, sums = None, 0, [0] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, bool)
            for k in keys:
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            own = [batch.column(k)[0].as_py() for k in keys]
            goes_on = last is not None and own == last
            change[0] = not goes_on
            at = np.flatnonzero(change)
            group = np.cumsum(change)  # 0: the key that goes on
            first = np.concatenate([[0], at])[group]
            number = np.arange(1, n + 1) - first + np.where(group == 0, seen, 0)
            out = [pa.array(number)]
            for i, v in enumerate(values):
                value = batch.column(v).fill_null(0).to_numpy(zero_copy_only=False)
                total = np.cumsum(value)
                before = np.where(first > 0, total[first - 1], 0)
                run = total - before + np.where(group == 0, sums[i], 0)
                out.append(pa.array(run))
                sums[i] = run[-1]
            last, seen = [batch.column(k)[-1].as_py() for k in keys], int(number[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *names])

    return work


_WHOLE = ("byte", "short", "integer", "long")


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: Sequence[str] = (), *, part: bool = False) -> DataFrame:
    """Adds ``row_no`` (from 1, by ``order`` within the key) and ``run_<v>`` for every value.

    Rows are cut into ranges of (keys, order), so a key of any size is spread over many tasks; a range
    starts from the totals of the ranges before it. One shuffle: numbers and sums run along the sorted
    ranges as they are written, and what lies before a range is added for keys that began in an earlier
    one, at most one row a range. Nulls add nothing to a running sum; sums are bigint or double. With
    ``part`` each row's range is kept (``_sl_part``); rows of a range that a task reads are in order.
    """
    keys, values = list(keys), list(values)
    by = [*[F.col(k) for k in keys], *order]
    kind = {v: "bigint" if df.schema[v].dataType.typeName() in _WHOLE else "double" for v in values}
    added = StructType([StructField("row_no", LongType()), *[StructField(f"run_{v}", DoubleType() if kind[v] == "double" else LongType()) for v in values]])
    plain = df.withColumns({v: F.col(v).cast(kind[v]) for v in values}) if values else df
    schema = StructType([*plain.schema.fields, *added.fields])
    ranges = plain.repartitionByRange(*by).sortWithinPartitions(*by)
    counted = ranges.mapInArrow(_carried(keys, values, added.names), schema)
    rows = stage(counted.withColumn(PART, F.spark_partition_id()), "ordered").df
    tail = F.max_by(F.struct(*added.names), "row_no")
    per_part = rows.groupBy(*keys, PART).agg(tail.alias("t"))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.sum(F.col("t")[c]).over(before).alias(f"_sl_b_{c}") for c in added.names}
    offsets = stage(per_part.select(*keys, PART, *sums.values()).where("_sl_b_row_no is not null"), "offsets")
    cond, side = null_safe(rows, offsets.df, [*keys, PART])
    joined = rows.join(small_side(side, offsets.df.count()), cond, "left")
    totals = [(F.col(c) + F.coalesce(f"_sl_b_{c}", F.lit(0))).alias(c) for c in added.names]
    return joined.select(*[rows[c] for c in [*df.columns, *([PART] if part else [])]], *totals)
