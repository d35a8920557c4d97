"""Random choices with a seed. Rows are drawn by a hash of their key, so a draw doesn't depend on how the table is divided."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators import ranges as R
from strandlake.operators.chunking import running_totals
from strandlake.session import stage


def _draw(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(k) for k in keys])


def sample_rows(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """n rows; equal keys are drawn together in an arbitrary order."""
    return df.orderBy(_draw(keys, seed), *keys).limit(n)


def shuffled(df: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    return df.orderBy(_draw(keys, seed), *keys)


def truncate(df: DataFrame, order: Sequence[str], size: str, n: int) -> DataFrame:
    """Rows in order until their sizes reach n; the row that crosses n is the last."""
    run = running_totals(df, [], [F.col(o) for o in order], [size])
    return run.where(F.col(f"run_{size}") - F.coalesce(size, F.lit(0)) < n).drop("row_no", f"run_{size}")


def chunk_numbers(df: DataFrame, order: Sequence[str], size: str, n: int) -> DataFrame:
    """Adds ``chunk``: rows in order, cut where the sizes' running total passes a multiple of n."""
    run = running_totals(df, [], [F.col(o) for o in order], [size])
    return run.withColumn("chunk", F.expr(f"(run_{size} - coalesce({size}, 0)) div {n}")).drop("row_no", f"run_{size}")


def thin(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Every k-th row in order, from the first."""
    return running_totals(df, [], [F.col(o) for o in order]).where((F.col("row_no") - 1) % k == 0).drop("row_no")


def select_by_flags(df: DataFrame, order: Sequence[str], flags: DataFrame, flag_order: Sequence[str], flag: str, match: str = "1") -> DataFrame:
    """Rows whose place in order has the wanted flag at the same place of another table."""
    a = running_totals(df, [], [F.col(o) for o in order])
    b = running_totals(flags, [], [F.col(o) for o in flag_order]).where(F.col(flag).cast("string") == match).select("row_no")
    return a.join(b, "row_no", "left_semi").drop("row_no")


def abut(a: DataFrame, order_a: Sequence[str], b: DataFrame, order_b: Sequence[str], cycle: int | None = None) -> DataFrame:
    """Two tables side by side by place; b's ``cycle`` rows are repeated if that is given."""
    x = running_totals(a, [], [F.col(o) for o in order_a])
    y = running_totals(b, [], [F.col(o) for o in order_b]).withColumnRenamed("row_no", "_sl_no")
    at = F.col("row_no") if cycle is None else (F.col("row_no") - 1) % cycle + 1
    return x.join(y, at == F.col("_sl_no"), "inner" if cycle else "left").drop("row_no", "_sl_no")


def shuffle_columns(components: DataFrame, seed: int = 0) -> DataFrame:
    """The columns of every block in a random order, the same for all its texts."""
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    keyed = F.transform(chars, lambda c, i: F.struct(F.xxhash64(F.lit(seed), F.col("block_id"), i).alias("h"), i.alias("i"), c.alias("c")))
    return components.withColumn("text", F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), ""))


def _place(regions: pd.DataFrame, lengths: np.ndarray, rng: np.random.Generator, overlap: bool) -> list[tuple[int, int]]:
    """Places for the lengths, longest first, within free stretches; a placed stretch is no longer free unless overlap is allowed."""
    begins, ends = (regions[c].to_numpy("int64") for c in ("start_pos", "end_pos"))
    m = len(begins)
    begins, ends = (np.concatenate([x[np.lexsort((ends, begins))], np.zeros(len(lengths), "int64")]) for x in (begins, ends))
    out = []
    for n in sorted(map(int, lengths), reverse=True):
        room = np.cumsum(np.maximum(ends[:m] - begins[:m] - n + 1, 0))
        if not m or not room[-1]:
            raise ValueError("no place is left for an interval")
        at = int(rng.integers(room[-1]))
        i = int(np.searchsorted(room, at, "right"))
        start = int(begins[i]) + at - (int(room[i - 1]) if i else 0)
        out.append((start, start + n))
        if not overlap:
            # What is left before the placed stretch stays where it was, what is left after it is added.
            begins[m], ends[m], ends[i] = start + n, ends[i], start
            m += 1
    return out


def throw_random(intervals: DataFrame, regions: DataFrame, *, samples: int = 1, seed: int = 0, overlap: bool = False) -> DataFrame:
    """chrom, sample, start, end: the lengths of a chrom's intervals placed at random within its regions.

    A chrom of one sample is placed in one task, as each place depends on those before it.
    """

    def work(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        chrom, sample = key
        rng = np.random.default_rng([seed, int(sample), *chrom.encode()])
        got = _place(right, (left["end_pos"] - left["start_pos"]).to_numpy(), rng, overlap) if len(left) else []
        return pd.DataFrame([(chrom, sample, s, e) for s, e in got], columns=["chrom", "sample", "start_pos", "end_pos"])

    numbered = F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")
    a = R.valid(intervals).select("chrom", "start_pos", "end_pos", numbered)
    b = R.valid(regions).select("chrom", "start_pos", "end_pos", numbered)
    return a.groupBy("chrom", "sample").cogroup(b.groupBy("chrom", "sample")).applyInPandas(work, "chrom string, sample int, start_pos bigint, end_pos bigint")


def overlap_test(a: DataFrame, b: DataFrame, regions: DataFrame, *, samples: int = 100, seed: int = 0) -> DataFrame:
    """One row: bases of a in b, mean and deviation over random placements of a, z and the share of samples below the observed."""
    mb = stage(R.merge(b), "merged").df
    seen = R.overlap_pairs(R.merge(a), mb).agg(F.coalesce(F.sum("overlap"), F.lit(0)).alias("observed"))
    thrown = stage(throw_random(R.merge(a), regions, samples=samples, seed=seed), "thrown").df
    every = thrown.sparkSession.range(samples).select(F.col("id").cast("int").alias("sample"))
    each = every.join(R.overlap_pairs(thrown, mb).groupBy("sample").agg(F.sum("overlap").alias("n")), "sample", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    both = each.join(F.broadcast(seen), how="cross")  # one row of observed bases
    s = both.groupBy("observed").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.avg((F.col("n") < F.col("observed")).cast("double")).alias("below"))
    return s.withColumn("z", F.when(F.col("sd") > 0, (F.col("observed") - F.col("mean")) / F.col("sd")))


def random_chop(components: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """block_id, low, high: pieces of ``length`` columns from a random first column of every block."""
    w = components.where("length(text) > 0").groupBy("block_id").agg(F.max(F.length("text")).alias("w"))
    first = F.pmod(F.xxhash64(F.lit(seed), "block_id"), F.lit(length))
    lows = F.sequence(first, F.greatest(F.col("w") - length, first), F.lit(length).cast("bigint"))
    return w.select("block_id", "w", F.explode(lows).alias("low")).where(F.col("low") + length <= F.col("w")).select("block_id", "low", (F.col("low") + length).alias("high"))
