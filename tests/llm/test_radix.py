import math
import random

from pyspark.sql import functions as F

from strandlake.llm.radix import combine, digest, percentiles, percentiles_of, value_of, with_bits


def data(n=600, seed=0):
    rng = random.Random(seed)
    pick = [0.0, -0.0, 1.0, -1.0, 5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, math.nan, None]
    return [(rng.choice(["a", "a", "a", "b", None]), rng.choice(pick) if rng.random() < 0.3 else rng.uniform(-100, 100)) for _ in range(n)]


def brute(rows, pcts, least=1):
    out = {}
    for k in {r[0] for r in rows}:
        v = sorted(x + 0.0 for g, x in rows if g == k and x is not None and not math.isnan(x))
        for p in pcts:
            if len(v) >= least:
                out[k, p] = v[max(1, -(-len(v) * p // 100)) - 1]
    return out


def test_order_and_round_trip(spark):
    v = sorted([-math.inf, -1.7e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, 2.5, 1.7e308, math.inf])
    df = with_bits(spark.createDataFrame([(x, x) for x in v] + [(0.5, None), (0.5, math.nan)], "v double, x double"), ["v"], "x")
    rows = df.select("v", F.col("_sl_bits").alias("b"), value_of(F.col("_sl_bits")).alias("w")).collect()
    assert [r["b"] for r in rows] == sorted(r["b"] for r in rows) and len({r["b"] for r in rows}) == len(v)
    assert all(r["v"] == r["w"] for r in rows)


def test_exact(spark):
    rows = data()
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "k string, v double, n int").repartition(3)
    got = {(r["k"], r["pct"]): r["value"] for r in percentiles(df, ["k"], "v", [0, 1, 50, 99, 100]).collect()}
    assert got == brute(rows, [0, 1, 50, 99, 100])
    assert percentiles(df, ["k"], "v", [50], min_count=10**6).collect() == []


def test_nothing(spark):
    assert percentiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", [50]).collect() == []


def test_states_combine_within_the_bound(spark):
    rows = data(900, 5)
    df = spark.createDataFrame(rows, "k string, v double")
    a, b = df.where("pmod(hash(v), 2) = 0 or v is null"), df.where("pmod(hash(v), 2) = 1")
    state = combine(digest(a, ["k"], "v", 24), digest(b, ["k"], "v", 24))
    want = brute(rows, [10, 50, 90])
    for r in percentiles_of(state, [10, 50, 90], 24).collect():
        true = want[r["k"], r["pct"]]
        assert r["value"] == true or 0 <= (true - r["value"]) / max(abs(true), 2.3e-308) < 2**-12
