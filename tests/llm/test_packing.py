import random
from collections import Counter, defaultdict

import pytest

from strandlake.llm.packing import Plan, pack


def check_plan(sizes, cap):
    plan = Plan(Counter(sizes), cap)
    load, seen = defaultdict(int), Counter()
    by = defaultdict(list)
    for length, low, first, per in plan.places:
        by[length].append((low, first, per))
    for length, n in Counter(sizes).items():
        places = sorted(by[length])
        for rank in range(n):
            low, first, per = max(p for p in places if p[0] <= rank)
            load[first + (rank - low) // per] += length
            seen[length] += 1
    assert seen == Counter(sizes)
    assert set(load) == set(range(plan.n_containers)) and all(v <= cap for v in load.values())
    return plan.n_containers


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_whole(seed):
    rng = random.Random(seed)
    cap = rng.choice([1, 2, 10, 100, 257])
    sizes = [rng.randrange(1, cap + 1) for _ in range(rng.choice([0, 1, 5, 300]))]
    n = check_plan(sizes, cap)
    assert n >= -(-sum(sizes) // cap) and (not sizes or n <= -(-sum(sizes) // cap) * 2)


def test_exact_complements_fill_containers():
    assert check_plan([60, 40] * 50, 100) == 50
    assert check_plan([50, 30, 20] * 20, 100) == 20
    assert check_plan([40, 30, 20, 10] * 9, 100) == 9
    assert check_plan([25] * 8, 100) == 2
    rng = random.Random(1)
    sizes = [rng.randrange(20, 400) for _ in range(4000)]
    assert check_plan(sizes, 1000) <= -(-sum(sizes) // 1000) * 1.005


def test_items(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, -3, 1, 7, 50, 100, 101, 350, rng.randrange(1, 100)]), "x") for i in range(500)]
    df = spark.createDataFrame(rows, "id int, n int, container_id string").repartition(5)
    got = pack(df, "id", "n", 100).collect()
    size = {i: max(n or 0, 0) for i, n, _ in rows}
    pieces, load = defaultdict(list), defaultdict(int)
    for r in got:
        pieces[r["id"]].append((r["piece_no"], r["start_token"], r["n_tokens"]))
        load[r["container_id"]] += r["n_tokens"]
    assert set(pieces) == set(size) and max(load.values()) <= 100
    for i, p in pieces.items():
        assert sum(x[2] for x in p) == size[i] and [x[1] for x in sorted(p)] == [100 * k for k in range(len(p))]
        assert len(p) == max(1, -(-size[i] // 100))
    assert sorted(load) == list(range(len(load)))


def test_nothing(spark):
    df = spark.createDataFrame([], "id int, n int")
    assert pack(df, "id", "n").collect() == []
    empty = spark.createDataFrame([(1, 0), (2, None)], "id int, n int")
    assert {r["container_id"] for r in pack(empty, "id", "n").collect()} <= {0, 1}
