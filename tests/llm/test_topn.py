import math
import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm.topn import cluster_by_group, top_n

SCHEMA = "rec_id bigint, chrom string, score bigint, v double, p double, extra string"


def rows(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        r = (i, rng.choice(["hot"] * 8 + ["a", "b", "c", None, f"s{rng.randrange(40)}"]), rng.choice([None, 1, 2, 3]), rng.choice([None, 0.0, -0.5, 1.5, 2.5, 7.0, float(rng.randrange(50))]), rng.choice([None, math.nan, 1.0]), "x")
        out.append(r)
    # Copies under other ids, also of the best.
    out += [(n + k, *rng.choice(out)[1:]) for k in range(n // 3)]
    return out


def brute(data, n):
    items = {}
    for rec, c, s, v, p, _ in data:
        if c is not None and v is not None:
            key = (c, s, v, "nan" if p is not None and math.isnan(p) else p)
            items[key] = min(rec, items.get(key, rec))
    out = set()
    for c in {k[0] for k in items}:
        own = sorted(((-k[2], k[1] is None, -(k[1] or 0), rec) for k, rec in items.items() if k[0] == c))
        out |= {(c, o[3]) for o in own[:n]}
    return out


@pytest.mark.parametrize("seed, n", [(0, 400), (1, 60)])
def test_against_brute_force(spark, seed, n):
    data = rows(seed, n)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = top_n(df, 10, "chrom", "v", then=["score"], unique_id="rec_id", same=["chrom", "score", "v", "p"])
    assert {(r["chrom"], r["rec_id"]) for r in got.collect()} == brute(data, 10)


def test_copies_of_the_best_fill_many_row_groups(spark):
    df = spark.range(40_000).select(
        F.col("id").alias("rec_id"), F.lit("one").alias("chrom"), F.lit(1).cast("bigint").alias("score"),
        F.when(F.col("id") < 39_990, 9.0).otherwise(F.col("id") - 39_990.0).alias("v"), F.lit(1.0).alias("p"),
    )
    got = top_n(df, 3, "chrom", "v", then=["score"], unique_id="rec_id", same=["chrom", "score", "v", "p"])
    # 9.0 under 39,990 ids is one item; id 39,999 equals it.
    assert sorted((r["v"], r["rec_id"]) for r in got.collect()) == [(7.0, 39_997), (8.0, 39_998), (9.0, 0)]


def test_one_large_group_is_hardly_read(spark):
    df = spark.range(200_000).select(F.col("id").alias("rec_id"), F.lit("one").alias("chrom"), F.rand(1).alias("v")).repartition(4)
    c = cluster_by_group(df, "chrom", "v", ["rec_id"])
    got = c.top_n(10, unique_id="rec_id")
    want = df.orderBy(F.desc("v"), "rec_id").limit(10)
    assert sorted(r["rec_id"] for r in got.collect()) == sorted(r["rec_id"] for r in want.collect())
    assert c.report["rows"] == 200_000 and 0 < c.report["rows_read"] < 1_000 and c.report["row_groups"] >= 10
    assert c.report["row_groups_read"] <= 4


def test_many_small_groups_and_a_large_one(spark):
    # 100,000 groups of 12 rows and one of 300,000; integer groups, scores beyond 2^53.
    small = spark.range(1_200_000).select("id", (F.col("id") % 100_000).cast("int").alias("g"))
    large = spark.range(1_200_000, 1_500_000).select("id", F.lit(-7).alias("g"))
    df = small.union(large).withColumn("v", F.lit(2**60) + F.xxhash64("id") % 1_000_000).withColumn("v", F.col("v").cast("bigint"))
    c = cluster_by_group(df, "g", "v", ["id"])
    got = c.top_n(1, unique_id="id")
    want = df.groupBy("g").agg(F.max_by("id", F.struct("v", -F.col("id"))).alias("id"))
    assert got.count() == 100_001 and got.join(want, ["g", "id"]).count() == 100_001
    assert c.report["rows"] == 1_500_000 and c.report["rows_read"] < 0.4 * c.report["rows"]
    # A second question needs no clustering.
    assert c.top_n(2, unique_id="id").count() == 200_002


def test_all_scores_equal_and_fewer_than_n(spark):
    df = spark.range(30_000).select(F.col("id").alias("rec_id"), F.when(F.col("id") < 29_995, "a").otherwise("b").alias("chrom"), F.lit(-0.0).alias("v"))
    df = df.union(df.select("rec_id", "chrom", F.lit(0.0))).union(df.select("rec_id", "chrom", F.lit(float("nan"))))
    got = top_n(df, 7, "chrom", "v", unique_id="rec_id")
    found = [(r["chrom"], r["rec_id"]) for r in got.collect()]
    assert sorted(set(found)) == [("a", i) for i in range(4)] + [("b", i) for i in range(29_995, 29_999)]
    assert len(found) == 14


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert top_n(df, 3, "chrom", "v", unique_id="rec_id").collect() == []
    gone = spark.createDataFrame([(1, None, 1, 1.0, 1.0, "x"), (2, "a", 1, None, 1.0, "x")], SCHEMA)
    assert top_n(gone, 3, "chrom", "v", unique_id="rec_id").collect() == []
