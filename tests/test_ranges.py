"""Interval operators against sets of positions."""

import random
from collections import defaultdict

import pytest

from strandlake.operators import ranges as R

SCHEMA = "id int, chrom string, start_pos bigint, end_pos bigint, strand string"


def make(seed, n, longest=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(600)
        out.append((i, rng.choice(["x", "x", "y", f"z{seed}"]), s, s + rng.choice([1, 2, 5, rng.randrange(1, longest), longest * 12 if rng.random() < 0.05 else 3]), rng.choice("+-.")))
    return out


def bases(rows):
    out = defaultdict(set)
    for _, c, s, e, *_ in rows:
        if c is not None and s is not None and e is not None:
            out[c] |= set(range(s, e))
    return out


def got_bases(df):
    out = defaultdict(set)
    for r in df.collect():
        new = set(range(r["start_pos"], r["end_pos"]))
        assert new and not new & out[r["chrom"]]
        out[r["chrom"]] |= new
    return {c: v for c, v in out.items() if v}


@pytest.fixture(params=[0, 1])
def ab(spark, request):
    a, b = make(request.param, 90), make(request.param + 10, 60)
    a += [(900, "x", 5, 5, "+"), (901, None, 1, 2, "+"), (902, "x", 700_000, 4_000_000, "-"), (903, "x", 3, None, "+")]
    b += [(900, "x", 1_000_000, 1_000_010, "+"), (901, "x", 511, 513, "+"), (902, "x", 512, 1024, "+")]
    return a, b, spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)


def fine(rows):
    return [r for r in rows if None not in r[1:4] and r[2] < r[3]]


def pairs(a, b, least=1):
    return [(x[0], y[0]) for x in fine(a) for y in fine(b) if x[1] == y[1] and min(x[3], y[3]) - max(x[2], y[2]) >= least]


def test_pairs(ab):
    a, b, da, db = ab
    for least in (1, 3):
        out = [(r["id"], r["b_id"]) for r in R.overlap_pairs(da, db, bring=["id"], min_cols=least).collect()]
        assert sorted(out) == sorted(pairs(a, b, least))


def test_full_join(ab):
    a, b, da, db = ab
    out = sorted((r["id"], r["b_id"]) for r in R.overlap_join(da, db, "id", "id", keep_a=True, keep_b=True).select("id", "b_id").fillna(-1).collect())
    p = pairs(a, b)
    want = p + [(x[0], -1) for x in a if x[0] not in {i for i, _ in p}] + [(-1, y[0]) for y in b if y[0] not in {j for _, j in p}]
    assert out == sorted(want)


def test_set_algebra(ab):
    a, b, da, db = ab
    x, y = bases(fine(a)), bases(fine(b))
    ma, mb = R.merge(da), R.merge(db)
    chroms = set(x) | set(y)
    keep = lambda d: {c: v for c, v in d.items() if v}
    assert got_bases(ma) == keep(x)
    assert got_bases(R.base_union(da, db)) == keep({c: x[c] | y[c] for c in chroms})
    assert got_bases(R.base_intersect(ma, mb)) == keep({c: x[c] & y[c] for c in chroms})
    assert got_bases(R.base_subtract(ma, mb)) == keep({c: x[c] - y[c] for c in chroms})
    assert got_bases(R.base_xor(da, db)) == keep({c: x[c] ^ y[c] for c in chroms})
    s = R.basewise_summary(da, db).collect()[0]
    total = lambda f: sum(len(f(c)) for c in chroms)
    assert tuple(s) == (total(lambda c: x[c] & y[c]), total(lambda c: x[c] - y[c]), total(lambda c: y[c] - x[c]))


def test_complement(ab, spark):
    _, b, _, db = ab
    small = [r for r in b if r[3] < 100_000]
    lens = spark.createDataFrame([("x", 2000), ("y", 700), ("q", 5), ("n", None)], "name string, length bigint")
    y = bases(fine(small))
    free = {c: set(range(n)) - y[c] for c, n in (("x", 2000), ("y", 700))}
    db = spark.createDataFrame(small, SCHEMA)
    assert got_bases(R.complement(db, lens)) == {c: v for c, v in free.items() if v}
    assert got_bases(R.complement(db, lens, all_chroms=True)) == {**free, "q": set(range(5))}


def test_coverage_counts_and_pieces(ab):
    a, b, da, db = ab
    y = bases(fine(b))
    cov = {x[0]: len(set(range(x[2], x[3])) & y[x[1]]) if x in fine(a) else 0 for x in a}
    assert {r["id"]: r["covered"] for r in R.coverage(da, db, "id").collect()} == cov
    p = pairs(a, b)
    assert {r["id"]: r["n_overlaps"] for r in R.count_overlaps(da, db, "id").collect()} == {x[0]: sum(i == x[0] for i, _ in p) for x in a}
    assert {r["id"] for r in R.semi(da, db, "id", min_cols=4).collect()} == {i for i, n in cov.items() if n >= 4}
    assert {r["id"] for r in R.semi(da, db, "id", min_cols=4, reverse=True).collect()} == {i for i, n in cov.items() if n < 4}
    by_id = {x[0]: x for x in a}
    for name, rows in (("in", R.intersect(da, [db], "id")), ("out", R.subtract(da, [db], "id"))):
        seen = defaultdict(set)
        for r in rows.collect():
            seen[r["id"]] |= set(range(r["start_pos"], r["end_pos"]))
        for x in fine(a):
            own = set(range(x[2], x[3]))
            assert seen[x[0]] == (own & y[x[1]] if name == "in" else own - y[x[1]]), (name, by_id[x[0]])


def test_nearest(ab):
    a, b, da, db = ab
    for side in ("before", "after"):
        want = set()
        for x in a:
            if None in x[1:4]:
                continue
            found = []
            for y in fine(b):
                if y[1] == x[1]:
                    d = x[2] - y[3] if side == "before" else y[2] - x[3]
                    if 0 < d <= 50:
                        found.append((d, y[2], y[3], y[0]))
            want |= {(x[0], y[3], y[0]) for y in sorted(found)[:2]}
        got = {(r["id"], r["near"], r["distance"]) for r in R.nearest(da, db, "id", "id", n=2, max_dist=50, side=side).collect()}
        assert got == {(i, n, d) for i, n, d in got} and {(i, n) for i, n, _ in got} == {(i, n) for i, n, _ in want}


def test_clusters(ab):
    a, _, da, _ = ab
    want = defaultdict(list)
    for c in {x[1] for x in fine(a)}:
        run, end = [], None
        for x in sorted((x for x in fine(a) if x[1] == c), key=lambda x: x[2]):
            if end is not None and x[2] - end > 5:
                want[c].append(run)
                run, end = [], None
            run.append(x)
            end = max(end or 0, x[3])
        want[c].append(run)
    expected = sorted((c, min(x[2] for x in r), max(x[3] for x in r), len(r)) for c, runs in want.items() for r in runs if len(r) >= 2)
    assert sorted(tuple(r) for r in R.clusters(da, "id", max_dist=5, min_members=2).collect()) == expected


def test_sweeps_over_many_ranges(spark):
    """Runs that cross ranges, gaps between files of a task, and a chrom that holds nearly all rows."""
    rng = random.Random(11)

    def rows(n):
        return [(i, rng.choice(["hot"] * 9 + ["x", "y", None]), s, s + rng.choice([0, 1, 3, 40, 900])) for i, s in enumerate(rng.randrange(4000) for _ in range(n))]

    def bases(data):
        return {(c, p) for _, c, s, e in data if c is not None for p in range(s, e)}

    def runs(found):
        out = [(r["chrom"], r["start_pos"], r["end_pos"]) for r in found.collect()]
        assert all(s < e for _, s, e in out)
        apart = sorted(out)
        assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(apart, apart[1:])), "runs are maximal"
        return {(c, p) for c, s, e in out for p in range(s, e)}

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for seed in range(1):
            x, y = rows(150 + seed), rows(60)
            a, b = (spark.createDataFrame(d, "rec_id int, chrom string, start_pos bigint, end_pos bigint") for d in (x, y))
            assert runs(R.base_intersect(a, b)) == bases(x) & bases(y)
            assert runs(R.base_subtract(a, b)) == bases(x) - bases(y)
            assert runs(R.base_xor(a, b)) == bases(x) ^ bases(y)
            one = R.basewise_summary(a, b).first()
            assert (one["in_both"], one["only_first"], one["only_second"]) == (len(bases(x) & bases(y)), len(bases(x) - bases(y)), len(bases(y) - bases(x)))
            n = {r["rec_id"]: r["n_overlaps"] for r in R.count_overlaps(a, b, "rec_id").collect()}
            want = {i: sum(c is not None and c == d and s < f and e > t and s < e and t < f for _, d, t, f in y) for i, c, s, e in x}
            assert n == want
            near = {(r["rec_id"], r["rank"]): r["near"] for r in R.nearest(a, b, "rec_id", "rec_id", n=2, max_dist=500).collect()}
            for i, c, s, e in x:
                best = sorted((s - f, t, f, j) for j, d, t, f in y if c is not None and d == c and t < f and f < s and s - f <= 500)[:2]
                assert [near.get((i, k)) for k in (1, 2)] == [*[v[3] for v in best], None, None][:2]
        none = a.where("false")
        assert R.base_intersect(none, none).collect() == [] and runs(R.base_subtract(a, none)) == bases(x)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
