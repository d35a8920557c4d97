"""Statistics, genes, alignment scores, streams and samples on small data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import probability as P
from strandlake.functions import sequence as S
from strandlake.operators import alignment as L
from strandlake.operators import genes as G
from strandlake.operators import motifs as M
from strandlake.operators import sampling as O
from strandlake.operators import stats as Z
from strandlake.streaming.intervals import growing_runs, latest_runs, run_pipeline, stream_intervals


def test_probabilities():
    # Known values of the distributions.
    assert P.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert P.chi2_tail([0.0, 18.307038053275146, 500.0], [10, 10, 10]) == pytest.approx([1, 0.05, 4.0e-101], rel=0.2, abs=1e-12)
    assert P.z_below(1.959963984540054) == pytest.approx(0.975)
    assert P.t_two_sided([2.2281388519649385, 0.0], [10, 10]) == pytest.approx([0.05, 1])
    assert P.f_tail([4.964602743730711], [1], [10]) == pytest.approx([0.05])
    assert P.ks_tail([1.3580986393225505])[0] == pytest.approx(0.05, abs=1e-4)
    assert P.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857142857)


def test_statistics(spark):
    x = [1.0, 2.0, 2.0, 3.0, 10.0, None]
    df = spark.createDataFrame([(i, v, 2 * v + 1 if v is not None else None, "a" if i % 2 else "b") for i, v in enumerate(x)], "id int, x double, y double, g string")
    d = Z.describe(df, [], "x").collect()[0]
    v = np.array(x[:5])
    m3, m4 = ((v - v.mean()) ** 3).mean(), ((v - v.mean()) ** 4).mean()
    assert (d["n"], d["mean"], d["geo_mean"], d["harm_mean"]) == pytest.approx((5, v.mean(), np.exp(np.log(v).mean()), 5 / (1 / v).sum()))
    assert (d["var_n"], d["var_n1"], d["skew"], d["kurt"]) == pytest.approx((v.var(), v.var(ddof=1), m3 / v.std() ** 3, m4 / v.var() ** 2))
    assert sorted((r["x"], r["rank"]) for r in Z.ranks(df, [], "x").collect()) == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (3.0, 4.0), (10.0, 5.0)]
    assert [(r["x"], r["n"]) for r in Z.modes(df, [], "x").collect()] == [(2.0, 2)]
    h = sorted((r["bin"], r["n"], r["cum"]) for r in Z.histogram(df, [], "x", 3).collect())
    assert [b for b, _, _ in h] == [0, 1, 2] and h[-1][2] == 5
    assert Z.spearman(df, [], "x", "y").collect()[0]["rho"] == pytest.approx(1)
    r = Z.linregress(df, [], "x", "y").collect()[0]
    assert (r["slope"], r["intercept"], r["r"]) == pytest.approx((2, 1, 1))
    assert sorted(q["id"] for q in Z.trim(df, [], "x", ["id"], 0.2).collect()) == [1, 2, 3]
    w = Z.wilcoxon(df.withColumn("z", F.lit(2.5)), [], "x", "z").collect()[0]
    assert (w["n"], w["w"]) == (5, 7.0)
    t = Z.ttest_1samp(df, [], "x", 3.6).collect()[0]
    assert t["t"] == pytest.approx(0, abs=1e-12) and t["p"] == pytest.approx(1)
    blocks = spark.createDataFrame([(b, k, float((b * 7 + k * 3) % 5)) for b in range(6) for k in range(3)], "b int, k int, x double")
    assert Z.friedman(blocks, "b", "k", "x").collect()[0]["n"] == 6


def test_spearman_of_large_groups(spark):
    # The cube of n is beyond a bigint in one group; in each the pairs (id % 2, id % 3) are equally many, so rho tends to 13 / 72.
    n, few = 2_100_000, 6_000
    df = spark.range(n + few).selectExpr(f"if(id < {n}, 'large', 'small') g", "id % 2 x", "id % 3 y")
    got = {r["g"]: (r["n"], r["rho"]) for r in Z.spearman(df, ["g"], "x", "y").collect()}
    assert {g: k for g, (k, _) in got.items()} == {"large": n, "small": few}
    for k, rho in got.values():
        assert rho == pytest.approx(1 - 59 / 72 * k**3 / (k**3 - k), abs=1e-12)


def test_genes(spark):
    g = spark.createDataFrame(
        [(1, "c", "+", 100, 200, 115, 184, [10, 20, 30], [0, 15, 70]), (2, "c", "-", 100, 200, 115, 184, [10, 20, 30], [0, 15, 70]), (3, "c", "+", 0, 9, 0, 0, [9], [0])],
        "line_id int, chrom string, strand string, chrom_start bigint, chrom_end bigint, cds_start bigint, cds_end bigint, block_sizes array<bigint>, block_starts array<bigint>",
    )
    span = lambda df, i: sorted((r["start_pos"], r["end_pos"]) for r in df.collect() if r["line_id"] == i)
    assert span(G.exons(g), 1) == [(100, 110), (115, 135), (170, 200)]
    assert span(G.introns(g), 1) == [(110, 115), (135, 170)] and span(G.introns(g), 3) == []
    # 20 + 14 coding bases: one too many at the far end of either strand.
    assert span(G.coding_exons(g), 1) == [(115, 135), (170, 183)]
    assert span(G.coding_exons(g), 2) == [(116, 135), (170, 184)]
    assert span(G.coding_exons(g), 3) == []
    assert span(G.regions(g, "utr5"), 1) == [(100, 115)] and span(G.regions(g, "utr5"), 2) == [(184, 200)]
    assert [G.degeneracy("GGG", i) for i in range(3)] == [1, 1, 4] and G.degeneracy("TTA", 0) == 2


def test_pair_scores_and_masks(spark):
    m = {(a, b): 10 if a == b else -5 for a in "ACGT" for b in "ACGT"}
    cases = [("ACGT", "ACGT", 40), ("AC--GT", "ACTTGT", 40 - 7 * 2 - 100), ("A-C", "A-C", 20), ("a-cg", "AT-G", 10 - 107 - 107 + 10), ("", "", 0), ("A--T", "A-TT", 20 - 107)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in df.select("i", L.pair_score(F.col("a"), F.col("b"), m, 100, 7).alias("s")).collect()}
    assert got == {i: s for i, (_, _, s) in enumerate(cases)}
    pair = spark.createDataFrame([("ACGTTG", "ACATCG")], "a string, b string")
    mask = lambda kind: pair.select(L.mask_columns(F.col("a"), L.cpg_columns(F.col("a"), F.col("b"), kind)).alias("m")).collect()[0]["m"]
    assert mask("inclusive") == "A##T##" and mask("restricted") == "ACGTTG"


def test_sequence_functions(spark):
    df = spark.createDataFrame([("a.b.chr1", "ACGTNn-R"), ("plain", "")], "src string, t string")
    r = df.select(S.src_species(F.col("src")).alias("sp"), S.src_sequence(F.col("src")).alias("sq"), S.reverse_complement(F.col("t")).alias("rc"), S.reverse_complement(F.col("t"), True).alias("ri")).collect()
    assert [tuple(x) for x in r] == [("a.b", "chr1", "R-nNACGT", "Y-nNACGT"), ("plain", None, "", "")]
    codes = df.where("src <> 'plain'").select(S.radix_codes([F.lit("ACX"), F.lit("CAA")], {"A": 0, "C": 1}).alias("c")).collect()[0]["c"]
    assert codes == [2, 1, -1]
    assert S.collapse_codes({0: 0, 1: 1, 2: 2}, 0, 1) == {0: 0, 1: 0, 2: 1} and S.expand_code({0: 0, 1: 0}, 1) == {0: 0, 1: 1}


def test_motifs(spark):
    m = M.log_odds(np.array([[9, 0, 0, 1], [0, 10, 0, 0], [0, 0, 10, 0]]), correction=0.01)
    plain, gapped = M.score_text(m, "ACGNACG"), M.score_text(m, "AC-GNT", gaps=True)
    assert plain[0] == pytest.approx(m.max(1).sum()) and plain[4] == plain[0] and np.isnan(plain[[1, 2, 3, 5, 6]]).all()
    assert gapped[0] == pytest.approx(plain[0]) and np.isnan(gapped[1:]).all()
    df = spark.createDataFrame([(1, "ACGTCGT"), (2, None), (3, "A")], "id int, t string")
    assert sorted((r["id"], r["col"], r["strand"]) for r in M.hits(df, ["id"], "t", m, 4.0, both_strands=True).collect()) == [(1, 0, "+"), (1, 1, "-"), (1, 4, "-")]
    assert sorted((r["id"], r["col"]) for r in M.exact_hits(spark.createDataFrame([(1, "aaaCaa"), (2, "")], "id int, t string"), ["id"], "t", "AA").collect()) == [(1, 0), (1, 1), (1, 4)]
    assert M.information(np.array([[1, 0, 0, 0], [1, 1, 1, 1]])) == pytest.approx([2, 0])
    assert M.scaled(m, m.max(1).sum()) == 1 and max(M.slide_correlation(m, m[1:])) == pytest.approx(1)


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "i int, n int")
    assert [r["i"] for r in O.sample_rows(df, ["i"], 5, 1).collect()] == [r["i"] for r in O.sample_rows(df.repartition(7), ["i"], 5, 1).collect()]
    assert sorted(r["i"] for r in O.truncate(df, ["i"], "n", 21).collect()) == list(range(7))
    assert sorted(r["i"] for r in O.thin(df, ["i"], 30).collect()) == [0, 30, 60, 90]
    iv = spark.createDataFrame([("x", 0, 10), ("x", 50, 55), ("y", 0, 3)], "chrom string, start_pos bigint, end_pos bigint")
    room = spark.createDataFrame([("x", 0, 12), ("x", 100, 120), ("y", 5, 8)], "chrom string, start_pos bigint, end_pos bigint")
    a, b = (sorted(tuple(r) for r in O.throw_random(iv, room.repartition(k), samples=3, seed=4).collect()) for k in (1, 3))
    assert a == b and len(a) == 9
    assert all(any(c == q["chrom"] and q["start_pos"] <= s and e <= q["end_pos"] for q in room.collect()) for c, _, s, e in a)
    for k in range(3):
        own = sorted((s, e) for c, n, s, e in a if c == "x" and n == k)
        assert own[0][1] <= own[1][0]


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bed").write_text("x\t1\t5\nx\t5\t8\ny\t1\t2\nbad\n")
    source = stream_intervals(spark, str(folder))
    q = growing_runs(source).writeStream.outputMode("update").format("memory").queryName("runs").start()
    held = lambda: sorted((r["chrom"], r["start_pos"], r["end_pos"]) for r in latest_runs(spark.table("runs")).collect())
    q.processAllAvailable()
    assert held() == [("x", 1, 8), ("y", 1, 2)]
    # A run that grows to the left takes back the one that was given before; one crosses a range's end.
    (folder / "b.bed").write_text(f"x\t0\t3\nx\t7\t12\ny\t4\t6\nx\t{2**20 - 2}\t{2**20 + 3}\n")
    q.processAllAvailable()
    assert held() == [("x", 0, 12), ("x", 2**20 - 2, 2**20 + 3), ("y", 1, 2), ("y", 4, 6)]
    (folder / "c.bed").write_text("y\t2\t4\n")
    q.processAllAvailable()
    got = held()
    q.stop()
    assert got == [("x", 0, 12), ("x", 2**20 - 2, 2**20 + 3), ("y", 1, 6)]
    run_pipeline(stream_intervals(spark, str(folder)), lambda d: d.select("chrom", "start_pos"), str(tmp_path / "out"), "t")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_fuse_breaks_at_gaps(spark):
    rows = [(b, n, b * 10 + n, f"s{n}", st, z, "+", 99, "A" * z) for b, (st, z) in enumerate([(0, 4), (4, 3), (9, 2), (11, 1)]) for n in (0, 1)]
    df = spark.createDataFrame(rows, "block_id int, comp_no int, comp_id int, src string, start_pos bigint, aln_size bigint, strand string, src_size int, text string")
    assert sorted((r["start_pos"], r["aln_size"], r["n_blocks"]) for r in L.fuse(df).where("comp_no = 0").collect()) == [(0, 7, 2), (9, 3, 2)]


def test_random_statistics_agree(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice("ab"), float(rng.randrange(8))) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, g string, x double")
    a, b = ([x for _, g, x in rows if g == k] for k in "ab")
    r = Z.mann_whitney(df, [], "x", F.col("g") == "a").collect()[0]
    u = sum((p > q) + 0.5 * (p == q) for p in a for q in b)
    assert r["u"] == pytest.approx(min(u, len(a) * len(b) - u))
    d = max(abs(sum(v <= t for v in a) / len(a) - sum(v <= t for v in b) / len(b)) for t in range(8))
    assert Z.ks_2samp(df, [], "x", F.col("g") == "a").collect()[0]["d"] == pytest.approx(d)
    t = Z.ttest_ind(df, [], "x", F.col("g") == "a").collect()[0]
    sp = ((len(a) - 1) * np.var(a, ddof=1) + (len(b) - 1) * np.var(b, ddof=1)) / (len(a) + len(b) - 2)
    assert t["t"] == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(sp * (1 / len(a) + 1 / len(b))))


def test_tiling(spark):
    from strandlake.operators import species as A

    blocks = [(1, "ref.c", 10, "AC-GTACG", "ACTGTA-G", 5.0), (2, "ref.c", 15, "CGTT", "CGAA", 9.0), (3, "ref.c", 30, "TT", None, 1.0)]
    rows = []
    for b, src, s, t0, t1, _ in blocks:
        rows.append((b, b * 10, 0, src, s, len(t0.replace("-", "")), "+", 100, t0))
        if t1:
            rows.append((b, b * 10 + 1, 1, "oth.x", 0, len(t1.replace("-", "")), "+", 100, t1))
    comps = spark.createDataFrame(rows, "block_id int, comp_id int, comp_no int, src string, start_pos bigint, aln_size bigint, strand string, src_size bigint, text string")
    scores = spark.createDataFrame([(b[0], b[5]) for b in blocks], "block_id int, score double")
    regions = spark.createDataFrame([("r", "ref.c", 8, 20), ("q", "ref.c", 30, 33)], "region string, chrom string, start_pos bigint, end_pos bigint")
    spans = A.reference_spans(comps).join(scores, "block_id")
    plan = sorted((r["region"], r["start_pos"], r["end_pos"], r["block_id"]) for r in A.tile_plan(regions, spans, "region").collect())
    assert plan == [("q", 30, 32, 3), ("q", 32, 33, None), ("r", 8, 10, None), ("r", 10, 15, 1), ("r", 15, 19, 2), ("r", 19, 20, None)]
    got = {(r["region"], r["species"]): r["text"] for r in A.tile_texts(regions, comps, "region", ["ref", "oth"], scores).collect()}
    assert got == {("r", "ref"): "**AC-GTACGTT*", ("r", "oth"): "**ACTGTACGAA*", ("q", "ref"): "TT*", ("q", "oth"): "--*"}


def test_chains_of_cigars(spark):
    from strandlake.operators import species as A

    items = spark.createDataFrame(
        [("h", "g", "1", 101, 110, "+", "4M2D6M"), ("m", "g", "2", 11, 19, "-", "6M3D3M")],
        "species string, gabid string, chrom string, start_pos bigint, end_pos bigint, strand string, cigar string",
    )
    sizes = spark.createDataFrame([("m", "2", 50)], "species string, name string, length bigint")
    got = sorted((r["t_start"], r["t_end"], r["q_start"], r["q_strand"]) for r in A.chain_blocks_of_cigars(items, "h", "m", sizes).collect())
    # Query position k on its own strand - is 50 - 19 + k from the sequence's end.
    assert got == [(100, 104, 31, "-"), (107, 110, 37, "-")]


def test_linear_model(spark):
    from strandlake.operators.species import linear_model

    df = spark.createDataFrame([(float(i), float(i * i), 3 + 2.0 * i - 0.5 * i * i) for i in range(9)] + [(1.0, None, 5.0)], "a double, b double, y double")
    assert linear_model(df, "y", ["a", "b"]) == pytest.approx({"intercept": 3, "a": 2, "b": -0.5})


def test_divergence_and_alignability(spark):
    from strandlake.operators import species as A

    iv = "chrom string, start_pos bigint, end_pos bigint"
    w = spark.createDataFrame([(1, "c", 0, 100), (2, "c", 200, 250), (3, "d", 0, 400)], f"w int, {iv}")
    snp = spark.createDataFrame([("c", 5, 6), ("c", 5, 6), ("c", 60, 62)], iv)
    div = spark.createDataFrame([("c", 7, 10), ("c", 220, 221)], iv)
    ar = spark.createDataFrame([("c", 0, 8)], iv)
    got = {r["w"]: (r["snp"], r["div"], r["ar_snp"], r["ar_div"]) for r in A.divergence_table(w, snp, div, ar, "w").collect()}
    assert got == {1: (3, 3, 1, 1), 2: (0, 1, 0, 0), 3: (0, 0, 0, 0)}
    aligned = spark.createDataFrame([("s", "c", 0, 50), ("s", "c", 40, 60), ("s", "d", 0, 100)], f"species string, {iv}")
    missing = spark.createDataFrame([("s", "c", 200, 230), ("s", "d", 300, 351)], f"species string, {iv}")
    got = {(r["w"], r["species"]): r["fraction"] for r in A.alignability(w, aligned, missing, "w", ["s", "t"]).collect()}
    assert got == {(1, "s"): 0.6, (2, "s"): None, (3, "s"): None, (1, "t"): 0.0, (2, "t"): 0.0, (3, "t"): 0.0}


def test_row_scores(spark):
    m = M.log_odds(np.array([[9, 0, 0, 1], [0, 10, 0, 0], [0, 0, 10, 0]]), correction=0.01)
    df = spark.createDataFrame([(1, "A-CG#ACG"), (2, None), (3, "CGT")], "id int, t string")
    got = {r["id"]: r["scores"] for r in M.row_scores(df, ["id"], "t", m).collect()}
    top = m.max(1).sum()
    assert set(got) == {1, 3} and got[1][0] == pytest.approx(top) and got[1][5] == pytest.approx(top) and got[3][0] == pytest.approx(top)
    assert [i for i, v in enumerate(got[1]) if v is not None] == [0, 5]
