"""Numeric signal along sequences: rows of (chrom, start_pos, end_pos, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators import ranges as R

CHROM, START, END = R.CHROM, R.START, R.END


def binned_summary(signal: DataFrame, regions: DataFrame, key: str, n_bins: int, value: str = "value") -> DataFrame:
    """key, bin, valid bases, min, max, sum and sum of squares of the signal in n equal bins of each region.

    Bins are (end - start) div n wide; what is left of a region belongs to none. Bins without signal come
    out with 0 bases and null extremes. Null and NaN values do not count.
    """
    width = F.expr(f"({END} - {START}) div {n_bins}")
    bins = R.valid(regions).withColumn("_sl_w", width).where("_sl_w > 0").select(
        key, CHROM, START, "_sl_w", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin")
    )
    low = F.col(START) + F.col("bin") * F.col("_sl_w")
    bins = bins.select(key, CHROM, "bin", low.alias(START), (low + F.col("_sl_w")).alias(END))
    fine = signal.where(F.col(value).isNotNull() & ~F.isnan(value))
    pairs = R.overlap_pairs(bins, fine, bring=[value])
    v, n = F.col(f"b_{value}"), F.col("overlap")
    agg = pairs.groupBy(key, "bin").agg(
        F.sum("overlap").alias("n_valid"), F.min(v).alias("min_val"), F.max(v).alias("max_val"),
        F.sum(v * n).alias("sum_val"), F.sum(v * v * n).alias("sum_squares"),
    )
    out = bins.select(key, "bin", (F.col(END) - F.col(START)).alias("width")).join(agg, [key, "bin"], "left")
    return out.withColumns({"n_valid": F.coalesce("n_valid", F.lit(0)), "sum_val": F.coalesce("sum_val", F.lit(0.0)), "sum_squares": F.coalesce("sum_squares", F.lit(0.0))})


def summary_query(signal: DataFrame, regions: DataFrame, key: str, n_bins: int, value: str = "value") -> DataFrame:
    """mean, max, min, coverage and std_dev (n - 1) of every bin; nulls where there is no signal."""
    s = binned_summary(signal, regions, key, n_bins, value)
    n = F.col("n_valid")
    var = (F.col("sum_squares") - F.col("sum_val") * F.col("sum_val") / n) / (n - 1)
    return s.select(
        key, "bin", F.when(n > 0, F.col("sum_val") / n).alias("mean"), "max_val", "min_val", (n / F.col("width")).alias("coverage"),
        F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std_dev"),
    )


def interval_scores(signal: DataFrame, regions: DataFrame, key: str, value: str = "value", mask: DataFrame | None = None, skip_zero: bool = False) -> DataFrame:
    """Average (by base), smallest and largest signal in each region, optionally outside a mask; nulls where there is none."""
    rows = signal.where(F.col(value).isNotNull() & ~F.isnan(value))
    if skip_zero:
        rows = rows.where(F.col(value) != 0)
    cut = regions.select(key, CHROM, START, END)
    if mask is not None:
        cut = R.subtract(cut, [mask], key)
    pairs = R.overlap_pairs(cut, rows, bring=[value])
    v, n = F.col(f"b_{value}"), F.col("overlap")
    agg = pairs.groupBy(key).agg((F.sum(v * n) / F.sum(n)).alias("avg_val"), F.min(v).alias("min_val"), F.max(v).alias("max_val"))
    return regions.select(key).join(agg, key, "left")


def scores_in_intervals(signal: DataFrame, regions: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, pos, value of every base of a region that has signal (the mean where signal rows overlap)."""
    pairs = R.overlap_pairs(regions.select(key, CHROM, START, END), signal.where(F.col(value).isNotNull()), bring=[value])
    low, high = F.greatest(START, f"b_{START}"), F.least(END, f"b_{END}")
    each = pairs.select(key, F.explode(F.sequence(low, high - 1)).alias("pos"), F.col(f"b_{value}").alias("v"))
    return each.groupBy(key, "pos").agg(F.avg("v").alias("value"))


def profile(signal: DataFrame, regions: DataFrame, key: str, flank: int, step: int, value: str = "value") -> DataFrame:
    """Mean signal by distance from the regions' centres, in steps; bases without signal do not count."""
    mid = F.expr(f"({START} + {END}) div 2")
    steps = R.valid(regions).select(key, CHROM, mid.alias("_sl_mid"), F.explode(F.sequence(F.lit(-flank), F.lit(flank - step), F.lit(step))).alias("offset"))
    around = steps.select(key, CHROM, "offset", (F.col("_sl_mid") + F.col("offset")).alias(START), (F.col("_sl_mid") + F.col("offset") + step).alias(END))
    pairs = R.overlap_pairs(around, signal.where(F.col(value).isNotNull() & ~F.isnan(value)), bring=[value])
    v, n = F.col(f"b_{value}"), F.col("overlap")
    return pairs.groupBy("offset").agg((F.sum(v * n) / F.sum(n)).alias("mean"), F.sum(n).alias("n_bases"))


def levels(signal: DataFrame, sizes: Sequence[int], value: str = "value") -> DataFrame:
    """Rollup tables: for every level's bin width, (chrom, level, bin) with count, min, max, sum, sum of squares by start.

    The finest level is aggregated from the rows, every other from the level below it.
    """
    rows = R.valid(signal).where(F.col(value).isNotNull() & ~F.isnan(value))
    v = F.col(value)
    low = rows.groupBy(CHROM, F.expr(f"{START} div {sizes[0]}").alias("bin")).agg(
        F.count("*").alias("n"), F.min(v).alias("min_val"), F.max(v).alias("max_val"), F.sum(v).alias("sum_val"), F.sum(v * v).alias("sum_squares")
    )
    out = low.withColumn("level", F.lit(sizes[0]))
    for a, b in zip(sizes, sizes[1:]):
        if b % a:
            raise ValueError("each level's width must be a multiple of the one below it")
        low = low.groupBy(CHROM, F.expr(f"bin div {b // a}").alias("bin")).agg(
            F.sum("n").alias("n"), F.min("min_val").alias("min_val"), F.max("max_val").alias("max_val"),
            F.sum("sum_val").alias("sum_val"), F.sum("sum_squares").alias("sum_squares"),
        )
        out = out.unionByName(low.withColumn("level", F.lit(b)))
    return out


def best_level(widths: Sequence[int], start: int, end: int, n_bins: int) -> int | None:
    """The widest level whose bins are at most half as wide as the asked ones; None: use the rows."""
    wanted = (end - start) // n_bins // 2
    return max((w for w in widths if w <= wanted), default=None)


def at_positions(signal: DataFrame, positions: DataFrame, value: str = "value", default: float | None = None) -> DataFrame:
    """positions (chrom, pos) with the signal there (the mean of overlapping rows), or the default."""
    points = positions.select(CHROM, F.col("pos").alias(START), (F.col("pos") + 1).alias(END)).distinct()
    found = R.overlap_pairs(points, signal, bring=[value]).groupBy(CHROM, F.col(START).alias("pos")).agg(F.avg(f"b_{value}").alias("value"))
    out = positions.join(found, [CHROM, "pos"], "left")
    return out.withColumn("value", F.coalesce("value", F.lit(default).cast("double")))


def letter_heights(counts: DataFrame, key: Sequence[str], letter: str, n: str) -> DataFrame:
    """Heights of a logo's letters: frequency times the column's information, log2(4) minus its entropy."""
    total = counts.groupBy(*key).agg(F.sum(n).alias("_sl_t"))
    f: Column = F.col(n) / F.col("_sl_t")
    rows = counts.join(total, list(key)).where("_sl_t > 0").withColumn("f", f)
    info = rows.groupBy(*key).agg((2 + F.sum(F.when(F.col("f") > 0, F.col("f") * F.log2("f")).otherwise(0))).alias("bits"))
    return rows.join(info, list(key)).select(*key, letter, (F.col("f") * F.col("bits")).alias("height"))
