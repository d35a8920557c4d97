import random
from collections import defaultdict

from strandlake.operators.chunking import RANK, key_totals, number_rows, running_totals


def rows(n=3000, seed=0):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(50)])) for i in range(n)]


def test_numbers_are_dense_within_the_key(spark):
    df = spark.createDataFrame(rows(), "id int, k string, v int").repartition(7)
    seen = defaultdict(list)
    for r in number_rows(df, ["k"]).df.collect():
        seen[r["k"]].append(r[RANK])
    assert sum(map(len, seen.values())) == 3000
    assert all(sorted(v) == list(range(len(v))) for v in seen.values())


def test_totals_do_not_depend_on_the_chunk(spark):
    data = rows()
    df = spark.createDataFrame(data, "id int, k string, v int").repartition(5)
    want = {}
    for k in {r[1] for r in data}:
        own = [r for r in data if r[1] == k]
        v = [r[2] for r in own if r[2] is not None]
        want[k] = (len(own), sum(v), min(v), max(v), own[0][2], own[-1][2])
    for chunk in (1, 7, 100, 10**6):
        got = key_totals(df, ["k"], sums=["v"], lows=["v"], highs=["v"], ends=["v"], order="id", chunk_rows=chunk).collect()
        assert {r["k"]: (r["n_rows"], r["sum_v"], r["min_v"], r["max_v"], r["first_v"], r["last_v"]) for r in got} == want


def test_totals_of_nothing(spark):
    assert key_totals(spark.createDataFrame([], "k string, v int"), ["k"], sums=["v"]).collect() == []


def test_running_totals(spark):
    data = rows(1000, 3)
    got = running_totals(spark.createDataFrame(data, "id int, k string, v int").repartition(6), ["k"], ["id"], ["v"]).collect()
    total, no = defaultdict(int), defaultdict(int)
    want = {}
    for i, k, v in data:
        total[k] += v or 0
        no[k] += 1
        want[i] = (no[k], total[k])
    assert {r["id"]: (r["row_no"], r["run_v"]) for r in got} == want


def test_running_totals_of_a_hot_key(spark):
    from pyspark.sql import functions as F

    from strandlake.operators.chunking import running_totals

    df = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "b").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"), (F.col("id") / 4).alias("w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: (r["row_no"], r["run_v"], r["run_w"]) for r in running_totals(df.repartition(3), ["k"], ["id"], ["v", "w"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state = {}
    for i in range(5000):
        k = "hot" if i % 10 else "b" if i % 20 else None
        n, v, w = state.get(k, (0, 0, 0.0))
        state[k] = (n + 1, v + (i if i % 7 else 0), w + i / 4)
        assert got[i] == state[k]
