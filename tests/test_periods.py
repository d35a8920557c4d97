import random

import pytest

from strandlake.operators.periods import periods_and_gaps

SCHEMA = "chrom string, start_pos bigint, end_pos bigint"


def brute(rows):
    out = set()
    by = {}
    for c, s, e in rows:
        if c is not None and s is not None and e is not None and s < e:
            by.setdefault(c, []).append((s, e))
    for c, iv in by.items():
        runs = []
        for s, e in sorted(iv):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        out |= {("period", c, s, e) for s, e in runs}
        out |= {("gap", c, a[1], b[0]) for a, b in zip(runs, runs[1:])}
    return out


def check(spark, rows, parts=None):
    df = spark.createDataFrame(rows, SCHEMA)
    if parts:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in periods_and_gaps(df).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_cases(spark):
    check(spark, [("a", 1, 5), ("a", 5, 9), ("a", 2, 3), ("a", 20, 30), ("a", 20, 30), ("b", 7, 8), ("b", 9, 9), ("b", 9, 2), (None, 1, 2), ("c", None, 4), ("c", 1, None)])


def test_empty(spark):
    check(spark, [])


@pytest.mark.parametrize("seed", range(4))
def test_ranges_are_joined(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(900):
        s = rng.randrange(3000)
        rows.append((rng.choice("aaaaaab"), s, s + rng.choice([1, 2, 3, 5, 40 if seed % 2 else 2])))
    rows.append(("long", 0, 10_000))
    check(spark, rows, parts=True)


def test_other_columns_do_not_clash(spark):
    df = spark.createDataFrame([("x", 1, 2, "y", 3)], "chrom string, start_pos bigint, end_pos bigint, kind string, part int")
    assert [tuple(r) for r in periods_and_gaps(df).collect()] == [("period", "x", 1, 2)]
