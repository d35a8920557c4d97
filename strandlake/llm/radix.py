"""Percentiles per group by radix selection.

Floating values become integers in the same order. Passes count successive 16-bit digits and follow
only the digit that holds a target rank, so no pass brings a group's values together and each keeps
at most 65,536 counts for a group and a target. Counts of one pass add up, so the histogram of the
leading digits is a state that partitions or days can combine, with a stated relative error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.session import small_side, stage

DIGITS = 4


def _bits(names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = (batch.columns[-1].to_numpy(zero_copy_only=False) + 0.0).view("int64")
            ordered = np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ordered)], names=names)

    return work


def with_bits(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and ``_sl_bits``, a bigint in the order of the double: -inf .. -0.0 = 0.0 .. inf. Null and NaN values are left out."""
    double = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(double)).select(*[F.col(k).alias(f"_sl_{i}") for i, k in enumerate(keys)], double.alias("_sl_v"))
    kinds = ", ".join(f"_sl_{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    names = [f"_sl_{i}" for i in range(len(keys))]
    out = rows.mapInArrow(_bits([*names, "_sl_bits"]), f"{kinds}, _sl_bits bigint" if keys else "_sl_bits bigint")
    return out.withColumnsRenamed(dict(zip(names, keys)))


def value_of(bits: Column) -> Column:
    """The double of an ordered bigint."""
    raw = F.when(bits < 0, bits.bitwiseXOR(F.lit(0x7FFFFFFFFFFFFFFF))).otherwise(bits)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def _digit(bits: Column, k: int) -> Column:
    """The k-th 16-bit digit from the top; the first is signed, which keeps the order."""
    top = F.shiftright(bits, 48)
    return top if k == 0 else F.shiftright(bits, 48 - 16 * k).bitwiseAND(F.lit(0xFFFF))


def percentiles(df: DataFrame, keys: Sequence[str], value: str, pcts: Sequence[int], min_count: int = 1) -> DataFrame:
    """keys, pct, n, value: the smallest value of the group such that at least pct percent are not greater.

    Exact: all digits are followed. Null and NaN values do not count; infinities are ordered at the
    ends, and -0.0 equals 0.0. Keys may be null (a group of their own). Groups with fewer than
    ``min_count`` values do not come out. An empty table gives no rows.
    """
    keys = list(keys)
    pcts = sorted({int(p) for p in pcts})
    table = stage(with_bits(df, keys, value), "radix")
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(1).alias("one"))
    bits = table.df.select(group.alias("_sl_g"), "_sl_bits")

    def follow(counts: DataFrame, by: list[str], k: int) -> DataFrame:
        """From counts per digit the digit that holds each target's rank, and the rank within it."""
        up = Window.partitionBy(*by).orderBy("_sl_d")
        return (
            counts.withColumn("_sl_upto", F.sum("_sl_c").over(up.rowsBetween(Window.unboundedPreceding, 0)))
            .where((F.col("_sl_upto") >= F.col("_sl_rank")) & (F.col("_sl_upto") - F.col("_sl_c") < F.col("_sl_rank")))
            .withColumn("_sl_rank", F.col("_sl_rank") - F.col("_sl_upto") + F.col("_sl_c"))
            .withColumn("_sl_prefix", F.lit(0).cast("bigint") if k == 0 else F.col("_sl_prefix"))
            .withColumn("_sl_prefix", F.shiftleft("_sl_prefix", 16) + F.col("_sl_d"))
            .select("_sl_g", "pct", "n", "_sl_prefix", "_sl_rank")
        )

    first = bits.groupBy("_sl_g", _digit(F.col("_sl_bits"), 0).alias("_sl_d")).agg(F.count("*").alias("_sl_c"))
    total = Window.partitionBy("_sl_g")
    wanted = (
        first.withColumn("n", F.sum("_sl_c").over(total))
        .where(F.col("n") >= min_count)
        .withColumn("pct", F.explode(F.array(*[F.lit(p) for p in pcts])))
        .withColumn("_sl_rank", F.greatest(F.lit(1), F.expr("(n * pct + 99) div 100")))
    )
    targets = stage(follow(wanted, ["_sl_g", "pct"], 0), "targets")
    for k in range(1, DIGITS):
        found = targets.df
        # One count per digit below a followed prefix, shared by the targets that follow it.
        prefixes = found.select(F.col("_sl_g").alias("_sl_pg"), F.col("_sl_prefix").alias("_sl_pp")).distinct()
        n_targets = found.count()
        here = F.shiftright("_sl_bits", 64 - 16 * k)
        within = bits.join(small_side(prefixes, n_targets), F.col("_sl_g").eqNullSafe(F.col("_sl_pg")) & (here == F.col("_sl_pp")), "left_semi")
        counts = within.groupBy("_sl_g", here.alias("_sl_p"), _digit(F.col("_sl_bits"), k).alias("_sl_d")).agg(F.count("*").alias("_sl_c"))
        both = counts.withColumnRenamed("_sl_g", "_sl_cg").join(
            small_side(found, n_targets), F.col("_sl_cg").eqNullSafe(F.col("_sl_g")) & (F.col("_sl_p") == F.col("_sl_prefix"))
        )
        was, targets = targets, stage(follow(both, ["_sl_g", "pct"], k), "targets")
        was.drop()
    table.drop()
    return targets.df.select(
        *[F.col("_sl_g")[k].alias(k) for k in keys], "pct", "n", value_of(F.col("_sl_prefix")).alias("value")
    )


def digest(df: DataFrame, keys: Sequence[str], value: str, bits: int = 24) -> DataFrame:
    """A state that can be combined: counts per key and leading ``bits`` of the ordered value.

    With b bits, 12 of them sign and exponent, percentiles read from it are off by less than
    2^(12 - b) of their size (of the smallest normal number, if they are below it). Null and NaN values
    do not count.
    """
    return with_bits(df, keys, value).groupBy(*keys, F.shiftright("_sl_bits", 64 - bits).alias("lead")).agg(F.count("*").alias("n"))


def combine(*states: DataFrame) -> DataFrame:
    """Adds states of separate partitions or days (same keys, same bits)."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def percentiles_of(state: DataFrame, pcts: Sequence[int], bits: int = 24) -> DataFrame:
    """keys, pct, n, value from a state: the lowest value that shares the percentile's leading bits (for
    negative values the one farthest from zero), so 0 <= (true - value) / |true| < 2^(12 - bits)."""
    keys = [c for c in state.columns if c not in ("lead", "n")]
    up = Window.partitionBy(*keys).orderBy("lead").rowsBetween(Window.unboundedPreceding, 0)
    counted = state.select(*keys, "lead", F.col("n").alias("_sl_c"))
    counted = counted.withColumn("_sl_upto", F.sum("_sl_c").over(up)).withColumn("n", F.sum("_sl_c").over(Window.partitionBy(*keys)))
    target = counted.withColumn("pct", F.explode(F.array(*[F.lit(int(p)) for p in pcts]))).withColumn(
        "_sl_rank", F.greatest(F.lit(1), F.expr("(n * pct + 99) div 100"))
    )
    hit = target.where((F.col("_sl_upto") >= F.col("_sl_rank")) & (F.col("_sl_upto") - F.col("_sl_c") < F.col("_sl_rank")))
    return hit.select(*keys, "pct", "n", value_of(F.shiftleft("lead", 64 - bits)).alias("value"))
