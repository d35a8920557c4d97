import random
import re

import numpy as np
import pytest

from strandlake.llm.splitting import cut_positions, split_components, split_texts


def text(rng, n):
    out = ""
    while len(out) < n:
        out += "".join(rng.choice("ACGTn") for _ in range(rng.randrange(1, rng.choice([30, 400, 1500])))) + "-" * rng.choice([1, 4, 5, 9])
    return out[:n]


def reachable(t, limit, overlap):
    """Whether cuts at boundaries alone are enough, by trying the farthest one each time."""
    marks = [m.end() for m in re.finditer("-{5,}", t) if m.end() < len(t)]
    begin = end = 0
    while len(t) - begin > limit:
        ahead = [b for b in marks if end < b <= begin + limit]
        if not ahead or ahead[-1] - overlap <= begin and ahead[-1] <= overlap:
            return False
        end = ahead[-1]
        begin = end - overlap
    return True


@pytest.mark.parametrize("limit, overlap", [(1000, 50), (60, 10), (20, 0)])
def test_pieces(limit, overlap):
    rng = random.Random(limit)
    for _ in range(120):
        t = text(rng, rng.randrange(limit + 1, limit * 9))
        marks = np.array([m.end() for m in re.finditer("-{5,}", t)], "int64")
        cuts, forced = cut_positions(len(t), marks, limit, overlap)
        begin = 0
        for c, f in zip(cuts, forced):
            assert begin + overlap < c <= begin + limit and (c in marks) != f
            begin = c - overlap
        assert len(t) - begin <= limit
        assert any(forced) != reachable(t, limit, overlap)


def cost(n, cuts, forced, penalties, limit, overlap):
    k = max(1, -(-(n - overlap) // (limit - overlap)))
    mean = (n + (k - 1) * overlap) / k
    begin, total = 0, 0.0
    for c in [*cuts, n]:
        total += ((c - begin - mean) / limit) ** 2
        begin = c - overlap
    return sum(forced), total + sum(penalties.get(c, 0.0) for c, f in zip(cuts, forced) if not f)


def cheapest(n, penalties, limit, overlap):
    """Every place as a cut, every piece length: the least cost of any division."""
    k = max(1, -(-(n - overlap) // (limit - overlap)))
    mean = (n + (k - 1) * overlap) / k
    best = {overlap: (0, 0.0)}
    for x in range(overlap + 1, n + 1):
        ways = [(best[a][0], best[a][1] + ((x - a + overlap - mean) / limit) ** 2) for a in range(max(overlap, x - limit + overlap), x) if a in best]
        if ways:
            f, c = min(ways)
            best[x] = (f, c) if x == n else (f, c + penalties[x]) if x in penalties else (f + 1, c)
    return best[n]


@pytest.mark.parametrize("weighted", [False, True])
def test_equals_the_exhaustive_programme(weighted):
    rng = random.Random(int(weighted))
    for _ in range(600):
        limit = rng.randrange(5, 60)
        overlap = rng.randrange(0, limit // 2)
        n = rng.randrange(limit + 1, limit * 8)
        marks = sorted(rng.sample(range(1, n), min(n - 1, rng.choice([0, 1, 3, 10, 40]))))
        penalties = {m: rng.choice([0.0, 0.1, 0.5]) if weighted else 0.0 for m in marks}
        given = [*marks, *marks[:3]]
        cuts, forced = cut_positions(n, np.array(given, "int64"), limit, overlap, np.array([penalties[m] for m in given], float))
        begin = 0
        for c, f in zip(cuts, forced):
            assert begin + overlap < c <= begin + limit and (c in penalties) >= (not f)
            begin = c - overlap
        assert n - begin <= limit
        got, want = cost(n, cuts, [f and c not in penalties for c, f in zip(cuts, forced)], penalties, limit, overlap), cheapest(n, penalties, limit, overlap)
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-9, (n, limit, overlap, marks)


def test_even_where_nothing_is_natural():
    cuts, forced = cut_positions(1945, np.array([60], "int64"), 1000, 50)
    assert len(cuts) == 1 and forced == [True] and abs(cuts[0] - 997) <= 1
    assert cut_positions(1900, np.array([400, 900, 960], "int64"), 1000, 50) == ([960], [False])


def test_a_very_long_text_of_many_boundaries():
    natural = np.arange(40, 3_000_000, 40)
    cuts, forced = cut_positions(3_000_000, natural, 1000, 50)
    assert not any(forced) and len(cuts) <= 3_000_000 / 900


def test_kinds_of_boundaries(spark):
    df = spark.createDataFrame([(1, "aaaa, bbbb. cccc, dddd, eeee. ffff")], "id int, text string")
    kinds = [(r"\. ", 0.0), (", ", 2.0)]
    got = split_texts(df, ["id"], "text", limit=20, overlap=0, boundary=kinds).orderBy("piece_no").collect()
    assert [r["piece_text"] for r in got] == ["aaaa, bbbb. ", "cccc, dddd, eeee. ", "ffff"]


def test_components(spark):
    rng = random.Random(3)
    long = text(rng, 5000)
    rows = [(1, 100, 3, long), (2, None, None, long), (3, 5, 5, "A" * 1000), (4, 5, 5, ""), (5, 5, 5, None), (6, 7, 1, "-" * 2500), (1, 100, 3, long)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "comp_id int, start_pos bigint, aln_size bigint, text string, forced string")
    got = split_components(df).collect()
    one = sorted((r for r in got if r["comp_id"] == 1), key=lambda r: r["piece_no"])
    assert {r["comp_id"] for r in got} == {1, 2, 6} and len(one) % 2 == 0
    for r in one:
        assert r["piece_text"] == long[r["col_start"] : r["col_end"]]
        assert r["start_pos"] == 100 + len(long[: r["col_start"]].replace("-", "")) and r["aln_size"] == len(r["piece_text"].replace("-", ""))
    assert all(r["start_pos"] is None for r in got if r["comp_id"] == 2)
    assert split_components(df.where("false")).collect() == []
