"""Grouped statistics. Values are doubles; nulls do not count. One pass of partial aggregation wherever sums are enough."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import probability as P
from strandlake.operators.chunking import running_totals
from strandlake.session import BROADCAST_ROWS, small_side, stage


#: Rows that share a value from which on the value isn't left to one task.
HEAVY_TIES = 100_000


def _rows(df: DataFrame, *values: str) -> DataFrame:
    for v in values:
        df = df.where(F.col(v).isNotNull())
    return df


def describe(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """n, extremes, means (geometric and harmonic over positive values only), variances by N and N - 1, errors, skew, kurtosis (not excess)."""
    v = F.col(x).cast("double")
    plus = F.when(v > 0, v)
    n = F.count(v)
    return _rows(df, x).groupBy(*keys).agg(
        n.alias("n"), F.min(v).alias("min_val"), F.max(v).alias("max_val"), F.avg(v).alias("mean"), F.exp(F.avg(F.ln(plus))).alias("geo_mean"),
        (F.count(plus) / F.sum(1 / plus)).alias("harm_mean"), F.var_pop(v).alias("var_n"), F.when(n > 1, F.var_samp(v)).alias("var_n1"),
        F.stddev_pop(v).alias("sd_n"), F.when(n > 1, F.stddev_samp(v) / F.sqrt(n)).alias("std_error"),
        (F.stddev_pop(v) / F.sqrt(n)).alias("sem"), (F.lit(100) * F.stddev_pop(v) / F.avg(v)).alias("variation"), F.skewness(v).alias("skew"), (F.kurtosis(v) + 3).alias("kurt"),
        F.sum(v).alias("total"), F.sum(v * v).alias("ss"), (F.sum(v) * F.sum(v)).alias("square_of_sum"),
    )


def item_freq(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    return _rows(df, x).groupBy(*keys, x).agg(F.count("*").alias("n"))


def modes(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """All most frequent values of a group."""
    freq = item_freq(df, keys, x)
    top = freq.groupBy(*keys).agg(F.max("n").alias("_sl_top"))
    return freq.join(top, list(keys)).where(F.col("n") == F.col("_sl_top")).select(*keys, x, "n") if keys else freq.join(top, how="cross").where("n = _sl_top").select(x, "n")


def histogram(df: DataFrame, keys: Sequence[str], x: str, n_bins: int = 10) -> DataFrame:
    """keys, bin, n, cum, rel, low_limit, bin_size. Bins span the group's values: the size is (range + range / bins + 1) / bins
    and the first begins half a size below the smallest value. Empty bins come out with 0."""
    keys = list(keys)
    ends = _rows(df, x).groupBy(*keys).agg(F.min(F.col(x).cast("double")).alias("lo"), F.max(F.col(x).cast("double")).alias("hi"), F.count("*").alias("total"))
    size = (F.col("hi") - F.col("lo") + (F.col("hi") - F.col("lo")) / n_bins + 1) / n_bins
    limits = ends.select(*keys, "total", size.alias("bin_size"), (F.col("lo") - size / 2).alias("low_limit"))
    at = F.floor((F.col(x) - F.col("low_limit")) / F.col("bin_size")).cast("int")
    joined = _rows(df, x).join(limits, keys) if keys else _rows(df, x).join(F.broadcast(limits), how="cross")
    counts = joined.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("k"))
    # One array of at most n_bins counts a group.
    listed = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("m"))
    both = limits.join(listed, keys) if keys else limits.join(listed, how="cross")
    each = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    withn = both.withColumn("c", each).select(*keys, "low_limit", "bin_size", "total", "c", F.posexplode("c").alias("bin", "n"))
    cum = F.aggregate(F.slice("c", F.lit(1), F.col("bin") + 1), F.lit(0).cast("bigint"), lambda s, v: s + v)
    return withn.select(*keys, "bin", "n", cum.alias("cum"), (F.col("n") / F.col("total")).alias("rel"), "low_limit", "bin_size", "total")


def score_at_percentile(df: DataFrame, keys: Sequence[str], x: str, share: float, n_bins: int = 10) -> DataFrame:
    """The value below which the share lies, interpolated in the histogram (0.5 with 1,000 bins: the histogram median)."""
    h = histogram(df, keys, x, n_bins)
    target = F.col("total") * share
    hit = h.where((F.col("cum") >= target) & (F.col("cum") - F.col("n") < target))
    value = F.col("low_limit") + F.col("bin_size") * (F.col("bin") + (target - F.col("cum") + F.col("n")) / F.col("n"))
    return hit.select(*keys, value.alias("score"))


def percentile_of_score(df: DataFrame, keys: Sequence[str], x: str, score: float, n_bins: int = 10) -> DataFrame:
    h = histogram(df, keys, x, n_bins)
    inside = (F.lit(score) - F.col("low_limit")) / F.col("bin_size") - F.col("bin")
    return h.where((inside >= 0) & (inside < 1)).select(*keys, ((F.col("cum") - F.col("n") + inside * F.col("n")) / F.col("total") * 100).alias("pct"))


def z_scores(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Rows with ``z``, by the standard deviation over N; null where that is 0."""
    s = _rows(df, x).groupBy(*keys).agg(F.avg(x).alias("_sl_m"), F.stddev_pop(x).alias("_sl_s"))
    joined = df.join(s, list(keys), "left") if keys else df.join(F.broadcast(s), how="cross")
    return joined.withColumn("z", F.when(F.col("_sl_s") > 0, (F.col(x) - F.col("_sl_m")) / F.col("_sl_s"))).drop("_sl_m", "_sl_s")


def ranks(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Rows with ``rank``: ties share their mean rank, and ``ties``, how many share it. Rows with a null value are left out."""
    keys = list(keys)
    freq = item_freq(df, keys, x).withColumnRenamed("n", "ties")
    run = running_totals(freq, keys, [F.col(x)], ["ties"])
    rank = stage(run.select(*keys, x, "ties", (F.col("run_ties") - F.col("ties") + (F.col("ties") + 1) / 2).alias("rank")), "ranks").df
    n, rows, on = rank.count(), _rows(df, x), [*keys, x]
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(rank), on)
    # Values that many rows share are few: they are broadcast, so no task gets all rows of one.
    heavy = rank.where(F.col("ties") > HEAVY_TIES)
    n_heavy = heavy.count()
    if not n_heavy:
        return rows.join(rank, on)
    marked = rows.join(small_side(heavy, n_heavy), on, "left")
    light = rank.where(F.col("ties") <= HEAVY_TIES)
    return marked.where("ties is not null").unionByName(marked.where("ties is null").drop("ties", "rank").join(light, on))


def trim(df: DataFrame, keys: Sequence[str], x: str, order: Sequence[str], share: float, tail: str | None = None) -> DataFrame:
    """Rows without the lowest and the highest int(share n) of each group, or those of one tail (``left``, ``right``)."""
    keys = list(keys)
    run = running_totals(_rows(df, x), keys, [F.col(x), *[F.col(o) for o in order]])
    n = run.groupBy(*keys).agg(F.count("*").alias("_sl_n"))
    joined = run.join(n, keys) if keys else run.join(F.broadcast(n), how="cross")
    cut = F.floor(F.col("_sl_n") * share)
    low, high = F.col("row_no") > cut, F.col("row_no") <= F.col("_sl_n") - cut
    keep = low if tail == "left" else high if tail == "right" else low & high
    return joined.where(keep).drop("row_no", "_sl_n")


def pearson(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    c = _rows(df, x, y).groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / ((1 - F.col("r") + 1e-20) * (1 + F.col("r") + 1e-20)))
    return c.withColumn("t", F.when(F.col("n") > 2, t)).withColumn("p", P.t_p(F.col("t"), (F.col("n") - 2).cast("double")))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """1 - 6 sum of squared rank differences / n (n^2 - 1)."""
    rx = ranks(_rows(df, x, y), keys, x).withColumnRenamed("rank", "_sl_rx").drop("ties")
    both = ranks(rx, keys, y).withColumn("_sl_d", F.col("_sl_rx") - F.col("rank"))
    n = F.col("n").cast("double")  # n (n^2 - 1) is more than a bigint holds beyond 2,097,152 rows
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("_sl_d") * F.col("_sl_d")).alias("d2")).select(
        *keys, "n", F.when(n > 1, 1 - 6 * F.col("d2") / (n * (n * n - 1))).alias("rho")
    )


def point_biserial(df: DataFrame, keys: Sequence[str], group: str, x: str) -> DataFrame:
    """Correlation of a 0/1 column with a value."""
    g, v = F.col(group).cast("double"), F.col(x).cast("double")
    a = _rows(df, group, x).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.when(g == 0, v)).alias("m0"), F.avg(F.when(g == 1, v)).alias("m1"), F.avg(g).alias("p1"), F.stddev_pop(v).alias("s")
    )
    return a.select(*keys, "n", F.when(F.col("s") > 0, (F.col("m1") - F.col("m0")) / F.col("s") * F.sqrt(F.col("p1") * (1 - F.col("p1")))).alias("r"))


def linregress(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    a = _rows(df, x, y).groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"), F.stddev_pop(y).alias("_sl_s")
    )
    return a.withColumn("std_err", F.sqrt(1 - F.col("r") * F.col("r")) * F.col("_sl_s")).drop("_sl_s")


def ttest_1samp(df: DataFrame, keys: Sequence[str], x: str, mean: float) -> DataFrame:
    a = _rows(df, x).groupBy(*keys).agg(F.count("*").alias("n"), ((F.avg(x) - mean) / (F.stddev_samp(x) / F.sqrt(F.count(x)))).alias("t"))
    return a.withColumn("p", P.t_p(F.col("t"), (F.col("n") - 1).cast("double")))


def _two(df: DataFrame, keys: Sequence[str], x: str, first: Column) -> DataFrame:
    v = F.col(x).cast("double")
    a, b = F.when(first, v), F.when(~first, v)
    return _rows(df, x).where(first.isNotNull()).groupBy(*keys).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2")
    )


def ttest_ind(df: DataFrame, keys: Sequence[str], x: str, first: Column) -> DataFrame:
    """Independent groups, told apart by a condition, with pooled variance."""
    s = _two(df, keys, x, first)
    dof = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    t = (F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    return s.select(*keys, "n1", "n2", t.alias("t"), P.t_p(t, dof.cast("double")).alias("p"))


def ttest_rel(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    d = F.col(x).cast("double") - F.col(y).cast("double")
    a = _rows(df, x, y).groupBy(*keys).agg(F.count("*").alias("n"), (F.avg(d) / (F.stddev_samp(d) / F.sqrt(F.count(d)))).alias("t"))
    return a.withColumn("p", P.t_p(F.col("t"), (F.col("n") - 1).cast("double")))


def chisquare(df: DataFrame, keys: Sequence[str], observed: str, expected: str | None = None) -> DataFrame:
    """One row a category; equal expectations unless a column gives them."""
    keys = list(keys)
    rows = _rows(df, observed)
    mean = rows.groupBy(*keys).agg(F.avg(observed).alias("_sl_e"))
    joined = rows.join(mean, keys) if keys else rows.join(F.broadcast(mean), how="cross")
    e = F.col(expected) if expected else F.col("_sl_e")
    a = joined.groupBy(*keys).agg(F.count("*").alias("k"), F.sum((F.col(observed) - e) * (F.col(observed) - e) / e).alias("chi2"))
    return a.withColumn("p", P.chi2_p(F.col("chi2"), (F.col("k") - 1).cast("double")))


def anova(df: DataFrame, keys: Sequence[str], group: str, x: str) -> DataFrame:
    """One-way F over the groups of a column."""
    v = F.col(x).cast("double")
    g = _rows(df, group, x).groupBy(*keys, group).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.var_pop(v).alias("v"))
    a = g.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("v") * F.col("n")).alias("w")
    )
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = F.col("w") / (F.col("n") - F.col("k"))
    out = a.select(*keys, "k", "n", (between / within).alias("f"))
    return out.withColumn("p", P.f_p(F.col("f"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")))


def mann_whitney(df: DataFrame, keys: Sequence[str], x: str, first: Column) -> DataFrame:
    """The smaller U, and z with ties corrected."""
    keys = list(keys)
    r = ranks(df.where(first.isNotNull()), keys, x)
    tie = F.sum((F.col("ties") * F.col("ties") - 1).cast("double"))
    a = r.groupBy(*keys).agg(F.count(F.when(first, 1)).alias("n1"), F.count(F.when(~first, 1)).alias("n2"), F.sum(F.when(first, F.col("rank"))).alias("r1"), tie.alias("tie"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u1 = n1 * n2 + n1 * (n1 + 1) / 2 - F.col("r1")
    correction = 1 - F.col("tie") / (n * n * n - n)
    z = (F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2) / F.sqrt(correction * n1 * n2 * (n + 1) / 12)
    return a.select(*keys, "n1", "n2", F.least(u1, n1 * n2 - u1).alias("u"), F.abs(z).alias("z")).withColumn("p", 1 - P.z_p(F.col("z")))


def rank_sums(df: DataFrame, keys: Sequence[str], x: str, first: Column) -> DataFrame:
    r = ranks(df.where(first.isNotNull()), list(keys), x)
    a = r.groupBy(*keys).agg(F.count(F.when(first, 1)).alias("n1"), F.count(F.when(~first, 1)).alias("n2"), F.sum(F.when(first, F.col("rank"))).alias("s"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    z = (F.col("s") - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return a.select(*keys, "n1", "n2", z.alias("z")).withColumn("p", 2 * (1 - P.z_p(F.abs(F.col("z")))))


def wilcoxon(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Signed ranks of paired values; pairs without a difference do not count."""
    d = _rows(df, x, y).withColumn("_sl_d", F.col(x).cast("double") - F.col(y)).where("_sl_d <> 0").withColumn("_sl_a", F.abs("_sl_d"))
    a = ranks(d, list(keys), "_sl_a").groupBy(*keys).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("_sl_d") > 0, F.col("rank"))), F.lit(0.0)).alias("up"),
        F.coalesce(F.sum(F.when(F.col("_sl_d") < 0, F.col("rank"))), F.lit(0.0)).alias("down"),
    )
    n, w = F.col("n").cast("double"), F.least("up", "down")
    z = F.abs(w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return a.select(*keys, "n", w.alias("w"), z.alias("z")).withColumn("p", 2 * (1 - P.z_p(F.col("z"))))


def kruskal(df: DataFrame, keys: Sequence[str], group: str, x: str) -> DataFrame:
    """H with ties corrected."""
    keys = list(keys)
    r = ranks(_rows(df, group), keys, x)
    g = r.groupBy(*keys, group).agg(F.count("*").alias("n"), F.sum("rank").alias("s"), F.sum((F.col("ties") * F.col("ties") - 1).cast("double")).alias("t"))
    a = g.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("t").alias("t"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return a.select(*keys, "k", "n", h.alias("h")).withColumn("p", P.chi2_p(F.col("h"), (F.col("k") - 1).cast("double")))


def friedman(df: DataFrame, block: str, treatment: str, x: str) -> DataFrame:
    """Chi-square of rank sums; values of a block are ranked among each other."""
    r = ranks(df, [block], x)
    g = r.groupBy(treatment).agg(F.sum("rank").alias("s"), F.countDistinct(block).alias("n"))
    a = g.agg(F.count("*").alias("k"), F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    chi2 = 12 / (k * n * (k + 1)) * F.col("q") - 3 * n * (k + 1)
    return a.select("k", "n", chi2.alias("chi2")).withColumn("p", P.chi2_p(F.col("chi2"), (F.col("k") - 1).cast("double")))


def ks_2samp(df: DataFrame, keys: Sequence[str], x: str, first: Column) -> DataFrame:
    """Largest difference of the two distribution functions."""
    keys = list(keys)
    c = _rows(df, x).where(first.isNotNull()).groupBy(*keys, x).agg(F.count(F.when(first, 1)).alias("c1"), F.count(F.when(~first, 1)).alias("c2"))
    run = running_totals(c, keys, [F.col(x)], ["c1", "c2"])
    n = c.groupBy(*keys).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    joined = run.join(n, keys) if keys else run.join(F.broadcast(n), how="cross")
    d = F.max(F.abs(F.col("run_c1") / F.col("n1") - F.col("run_c2") / F.col("n2")))
    a = joined.groupBy(*keys, "n1", "n2").agg(d.alias("d"))
    en = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")).cast("double"))
    return a.withColumn("p", P.ks_p((en + 0.12 + 0.11 / en) * F.col("d")))


def obrien(df: DataFrame, group: str, x: str) -> DataFrame:
    """Rows with ``r``, whose mean by group is the group's variance (for a test of equal variances)."""
    s = _rows(df, group, x).groupBy(group).agg(F.count("*").alias("_n"), F.var_samp(x).alias("_v"), F.avg(x).alias("_m"))
    n, v, d = F.col("_n"), F.col("_v"), F.col(x) - F.col("_m")
    r = ((n - 1.5) * n * d * d - 0.5 * v * (n - 1)) / ((n - 1) * (n - 2))
    return _rows(df, group, x).join(s, group).withColumn("r", F.when(n > 2, r)).drop("_n", "_v", "_m")


def trimmed(df: DataFrame, keys: Sequence[str], x: str, low: float, high: float) -> DataFrame:
    """n, mean, variance, extremes, deviation and error of the values within [low, high]."""
    v = F.when((F.col(x) >= low) & (F.col(x) <= high), F.col(x).cast("double"))
    return _rows(df, x).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("t_mean"), F.var_samp(v).alias("t_var"), F.min(v).alias("t_min"), F.max(v).alias("t_max"),
        F.stddev_samp(v).alias("t_sd"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("t_sem"),
    )


def normality(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """z of the skew and of the kurtosis, their squares' sum and its probability."""
    d = describe(df, keys, x).select(*keys, "n", "skew", "kurt")
    n, b = F.col("n").cast("double"), F.col("skew")
    y = b * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta - 1))
    delta, alpha = 1 / F.sqrt(0.5 * F.ln(w2)), F.sqrt(2 / (w2 - 1))
    ratio = y / alpha
    zs = delta * F.ln(ratio + F.sqrt(ratio * ratio + 1))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    k = (F.col("kurt") - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    inner = (1 - 2 / a) / (1 + k * F.sqrt(2 / (a - 4)))
    zk = (1 - 2 / (9 * a) - F.signum(inner) * F.pow(F.abs(inner), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    out = d.where("n > 8").select(*keys, "n", zs.alias("z_skew"), zk.alias("z_kurt"))
    chi2 = F.col("z_skew") * F.col("z_skew") + F.col("z_kurt") * F.col("z_kurt")
    return out.withColumn("chi2", chi2).withColumn("p", P.chi2_p(F.col("chi2"), F.lit(2.0)))


def covariance(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """a, b, covariance (N - 1) and correlation of every pair of the named columns, both orders."""
    pairs = [(a, b) for a in columns for b in columns]
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(a, b).alias("cov"), F.corr(a, b).alias("corr")) for a, b in pairs]
    return df.groupBy(*keys).agg(F.array(*each).alias("m")).select(*keys, F.inline("m"))


def signal_to_noise(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    return _rows(df, x).groupBy(*keys).agg(F.when(F.stddev_pop(x) > 0, F.avg(x) / F.stddev_pop(x)).alias("snr"))
