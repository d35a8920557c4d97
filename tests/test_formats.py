"""Readers, writers and the operators behind them, on small texts."""

import struct
import zlib

import numpy as np
import pytest

from strandlake.operators import alignment as L
from strandlake.operators import liftover as C
from strandlake.sinks import text as K
from strandlake.sources import binary as B
from strandlake.sources import blocks as X
from strandlake.sources import sequences as Q
from strandlake.sources import text as T

MAF = """##maf version=1 scoring=none

a score=10.5
s aa.chr1 10 5 + 100 AC-GTA
i aa.chr1 N 0 C 0
s bb.chr2 3  6 - 50  ACCGTA
q bb.chr2            999999
e cc.chr3 7 0 + 60 I

a score=3
s aa.chr1 15 2 + 100 GT
s bb.chr2 9  2 - 50  GT

"""
CHAIN = """chain 500 chr1 1000 + 100 130 chrA 500 - 10 37 7
10 3 0
12 2 2
3

chain 20 chr2 1000 + 0 5 chrB 500 + 1 6 8
5

"""
WIG = """track type=wiggle_0
chr0 1 5 2.5
variableStep chrom=chr1 span=2
11 1.5
21 -3
fixedStep chrom=chr2 start=5 step=10 span=5
1
2
"""


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


FORMS = {"plain": lambda t: t, "crlf": lambda t: t.replace("\n", "\r\n"), "blanks": lambda t: t.replace("\n\n", "\n \t\n"), "no end": lambda t: t.rstrip(), "more": lambda t: t.replace("\n\n", "\n\n\n# a remark\n\n")}


@pytest.mark.parametrize("form", FORMS)
def test_line_ends_and_blank_lines(spark, tmp_path, form):
    turn = FORMS[form]
    maf = X.read_maf(spark, put(tmp_path, "x.maf", turn(MAF))).collect()
    assert sorted((r["score"], r["comp_no"], r["src"], r["text"], r["empty_status"], r["right_len"]) for r in maf if r["score"] == 3) == [
        (3.0, 0, "aa.chr1", "GT", None, None), (3.0, 1, "bb.chr2", "GT", None, None)
    ]
    assert len(maf) == 5 and len({r["block_id"] for r in maf}) == 2
    axt = X.read_axt(spark, put(tmp_path, "x.axt", turn("0 a 11 13 b 5 7 - 90\nACG\nA-G\n\n1 a 20 21 c 1 2 + 7\nAC\nGT\n\n"))).collect()
    assert sorted((r["src"], r["comp_no"], r["start_pos"], r["aln_size"], r["strand"], r["text"], r["score"]) for r in axt) == [
        ("a", 0, 10, 3, "+", "ACG", 90.0), ("a", 0, 19, 2, "+", "AC", 7.0), ("b", 1, 4, 3, "-", "A-G", 90.0), ("c", 1, 0, 2, "+", "GT", 7.0)
    ]
    chains = {r["chain_id"]: r for r in X.read_chains(spark, put(tmp_path, "x.chain", turn(CHAIN))).collect()}
    assert chains["7"]["sizes"] == [10, 12, 3] and chains["7"]["dt"] == [3, 2, 0] and chains["8"]["sizes"] == [5] and len(chains) == 2
    fasta = Q.read_fasta(spark, put(tmp_path, "x.fa", turn(">one a > b\nACG\nTT\n\n>two\nGG\n\n"))).collect()
    assert sorted((r["name"], r["text"]) for r in fasta if form != "more") == ([("one", "ACGTT"), ("two", "GG")] if form != "more" else [])


def test_blocks_over_many_splits(spark, tmp_path):
    n = 3000
    axt = "".join(f"{k} a {k + 1} {k + 3} b 5 7 - {k}\nACG\nA-G\n\n" for k in range(n))
    maf = "##maf version=1\n\n" + "".join(f"a score={k}\ns a.c {k} 2 + 9000 A-C\ns b.d 1 3 - 9 AAC\n\n" for k in range(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = X.read_axt(spark, put(tmp_path, "y.axt", axt)).collect()
        rows = X.read_maf(spark, put(tmp_path, "y.maf", maf)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["score"], r["start_pos"]) for r in got if r["comp_no"] == 0) == [(float(k), k) for k in range(n)] and len(got) == 2 * n
    assert sorted((r["score"], r["comp_no"]) for r in rows) == [(float(k), c) for k in range(n) for c in (0, 1)] and len({r["block_id"] for r in rows}) == n


def test_maf_round_trip(spark, tmp_path):
    c = X.read_maf(spark, put(tmp_path, "x.maf", MAF)).collect()
    by = {(r["score"], r["comp_no"]): r for r in c}
    assert len(c) == 5
    one = by[10.5, 0]
    assert (one["src"], one["start_pos"], one["aln_size"], one["strand"], one["src_size"], one["text"]) == ("aa.chr1", 10, 5, "+", 100, "AC-GTA")
    assert (one["left_status"], one["left_len"], one["right_status"], one["right_len"]) == ("N", 0, "C", 0)
    assert by[10.5, 1]["quality"] == "999999" and by[10.5, 1]["left_status"] is None
    assert by[10.5, 2]["empty_status"] == "I" and by[10.5, 2]["text"] is None
    K.write_maf(X.read_maf(spark, str(tmp_path / "x.maf")), str(tmp_path / "out"))
    again = X.read_maf(spark, str(tmp_path / "out")).collect()
    strip = lambda rows: sorted(str(r[1:]) for r in rows)
    assert strip(again) == strip(c)
    empty = put(tmp_path, "e.maf", "##maf version=1\n")
    assert X.read_maf(spark, empty).collect() == []


def test_fuse_and_thread(spark, tmp_path):
    c = X.read_maf(spark, put(tmp_path, "x.maf", MAF), e_rows=False).withColumnRenamed("score", "s").drop("s")
    fused = L.fuse(c.withColumn("comp_id", c["comp_no"])).collect()
    assert sorted((r["src"], r["start_pos"], r["aln_size"], r["text"], r["n_blocks"]) for r in fused) == [("aa.chr1", 10, 7, "AC-GTAGT", 2), ("bb.chr2", 3, 8, "ACCGTAGT", 2)]
    only = L.thread_species(c.withColumn("comp_id", c["comp_no"]), ["aa"]).collect()
    assert sorted(r["text"] for r in only) == ["ACGTA", "GT"]


def test_axt(spark, tmp_path):
    p = put(tmp_path, "x.axt", "0 chr1 11 15 chr2 4 9 - 77\nAC-GTA\nACCGTA\n\n")
    got = sorted((r["comp_no"], r["src"], r["start_pos"], r["aln_size"], r["strand"], r["text"], r["score"]) for r in X.read_axt(spark, p).collect())
    assert got == [(0, "chr1", 10, 5, "+", "AC-GTA", 77.0), (1, "chr2", 3, 6, "-", "ACCGTA", 77.0)]
    two = spark.createDataFrame([(5, 0, "a", 10, 5, "-", 100, "AC-GTA"), (5, 1, "b", 3, 6, "-", 50, "ACCGTA")], "block_id int, comp_no int, src string, start_pos int, aln_size int, strand string, src_size int, text string")
    assert K.axt_blocks(two).collect()[0]["value"] == "5 a 86 90 b 42 47 + 0\nTAC-GT\nTACGGT\n"


def test_chains_map_elements(spark, tmp_path):
    chains = X.read_chains(spark, put(tmp_path, "x.chain", CHAIN))
    assert {r["chain_id"]: (r["sizes"], r["dt"], r["dq"]) for r in chains.collect()} == {"7": ([10, 12, 3], [3, 2, 0], [0, 2, 0]), "8": ([5], [0], [0])}
    blocks = C.chain_blocks(chains)
    assert sorted(tuple(r) for r in blocks.select("chain_id", "t_start", "t_end", "q_start").collect()) == [("7", 100, 110, 10), ("7", 113, 125, 20), ("7", 127, 130, 34), ("8", 0, 5, 1)]
    e = spark.createDataFrame([("in", "chr1", 102, 105), ("over", "chr1", 108, 115), ("gap", "chr1", 110, 113), ("plus", "chr2", 1, 4)], "id string, chrom string, start_pos bigint, end_pos bigint")
    got = {r["id"]: (r["chrom"], r["start_pos"], r["end_pos"], r["n_blocks"], r["mapped"]) for r in C.liftover(e, blocks, "id").collect()}
    # Query positions count from the end of a sequence of 500 on strand -.
    assert got == {"in": ("chrA", 485, 488, 1, 3), "over": ("chrA", 478, 482, 2, 4), "plus": ("chrB", 2, 5, 1, 3)}
    assert set(r["id"] for r in C.liftover(e, blocks, "id", threshold=0.6).collect()) == {"in", "plus"}
    bad = put(tmp_path, "bad.chain", CHAIN.replace("10 3 0", "10 4 0"))
    with pytest.raises(Exception, match="add up"):
        X.read_chains(spark, bad).collect()


def test_wiggle(spark, tmp_path):
    got = sorted(tuple(r) for r in T.read_wiggle(spark, put(tmp_path, "x.wig", WIG)).collect())
    assert got == [("chr0", 1, 5, "+", 2.5), ("chr1", 10, 12, "+", 1.5), ("chr1", 20, 22, "+", -3.0), ("chr2", 4, 9, "+", 1.0), ("chr2", 14, 19, "+", 2.0)]
    assert T.by_position(T.read_wiggle(spark, str(tmp_path / "x.wig"))).count() == 4 + 4 + 10


def test_intervals(spark, tmp_path):
    p = put(tmp_path, "x.bed", "#c\ntrack name=x\nchr1\t5\t9\tn\t0\t-\nchr1\t9\t5\nchr1\tx\t5\nchr1\nchr2\t1\t2\tn\t0\t*\r\nchr3\t1\t2\n\n")
    assert sorted((r["chrom"], r["strand"]) for r in T.read_intervals(spark, p).collect()) == [("chr1", "-"), ("chr3", "+")]
    assert sorted(r["error"] for r in T.bad_intervals(spark, p).collect()) == ["end before start", "missing field", "start is not a whole number", "strand is neither + nor -"]
    assert T.read_intervals(spark, p, fix_strand=True).count() == 3
    with pytest.raises(Exception):
        T.read_intervals(spark, p, strict=True).collect()
    lens = T.read_lengths(spark, put(tmp_path, "x.len", "chr1 8\nchr3\t50\n"))
    assert [r["chrom"] for r in T.read_intervals(spark, p, lengths=lens).collect()] == ["chr3"]
    with pytest.raises(Exception, match="repeated name"):
        T.read_lengths(spark, put(tmp_path, "y.len", "a 1\na 2\n")).collect()
    t = T.read_table(spark, put(tmp_path, "t.tab", "#a\tb\n1\t2\n\n#no\n3\n"))
    assert t.columns == ["a", "b"] and sorted(tuple(r) for r in t.collect()) == [("1", "2"), ("3", None)]


def test_fasta_and_extraction(spark, tmp_path):
    f = Q.read_fasta(spark, put(tmp_path, "x.fa", ">one first\nACGTAC\nGT nn\n>two\nTTTTT\n"))
    rows = {r["name"]: (r["description"], r["text"]) for r in f.collect()}
    assert rows == {"one": ("one first", "ACGTACGTnn"), "two": ("two", "TTTTT")}
    c = Q.chunked(f, 4)
    assert {r["name"]: r["length"] for r in Q.sequence_names(c).collect()} == {"one": 10, "two": 5}
    regions = spark.createDataFrame([(1, "one", 2, 9, "+"), (2, "one", 2, 9, "-"), (3, "two", 4, 5, "+")], "id int, chrom string, start_pos bigint, end_pos bigint, strand string")
    assert {r["id"]: r["text"] for r in Q.extract(c, regions, "id", size=4, strand="strand").collect()} == {1: "GTACGTn", 2: "nACGTAC", 3: "T"}


def twobit(seqs):
    body, at = b"", {}
    head = 16 + sum(1 + len(n) + 4 for n in seqs)
    for n, s in seqs.items():
        at[n] = head + len(body)
        runs = []
        for want in (lambda ch: ch in "Nn", str.islower):
            r, i = [], 0
            while i < len(s):
                j = i
                while j < len(s) and want(s[j]):
                    j += 1
                if j > i:
                    r.append((i, j - i))
                i = max(j, i + 1)
            runs.append(r)
        b = struct.pack("<I", len(s))
        for r in runs:
            b += struct.pack("<I", len(r)) + b"".join(struct.pack("<I", x[0]) for x in r) + b"".join(struct.pack("<I", x[1]) for x in r)
        codes = ["TCAG".find(ch.upper()) if ch.upper() in "TCAG" else 0 for ch in s] + [0] * (-len(s) % 4)
        body += b + b"\0" * 4 + bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, len(codes), 4))
    return struct.pack("<IIII", B.TWOBIT, 0, len(seqs), 0) + b"".join(bytes([len(n)]) + n.encode() + struct.pack("<I", at[n]) for n in seqs) + body


def test_twobit_and_nib(spark, tmp_path):
    B.register(spark)
    s = "ACGTNNNNacgtTTGCAnnGATTACA"
    p = put(tmp_path, "x.2bit", twobit({"c1": s, "c2": "TTTTA"}))
    rows = spark.read.format("twobit").option("path", p).option("chunk", "7").load().orderBy("name", "chunk_start").collect()
    want = s.replace("n", "N")
    assert "".join(r["text"] for r in rows if r["name"] == "c1").upper() == want.upper() and rows[-1]["text"] == "TTTTA"
    t = B.TwoBit(p)
    for a in range(0, 26, 3):
        for b in range(a, 27, 2):
            assert t.get("c1", a, b, mask=False) == s[a:b].upper()
            assert t.get("c1", a, b)[0:1].islower() == (a < b and s[a].islower())
    one = spark.read.format("twobit").option("path", p).load().where("name = 'c2'")
    assert [r["text"] for r in one.collect()] == ["TTTTA"]
    codes = [("TCAGN".index(c.upper()) | (8 if c.islower() else 0)) for c in s] + [0] * (len(s) % 2)
    nib = struct.pack("<II", B.NIB, len(s)) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    q = put(tmp_path, "x.nib", nib)
    assert B.nib_text(q) == s and B.nib_text(q, 3, 10) == s[3:10]
    chunks = spark.read.format("nib").option("path", q).option("chunk", "5").load().orderBy("chunk_start").collect()
    assert "".join(r["text"] for r in chunks) == s


def bigwig(chroms, blocks, packed=True):
    """blocks: (kind, chrom id, rows); a file of one tree leaf."""
    key = max(len(c) for c in chroms)
    head, tree_at = 64, 64
    tree = struct.pack("<IIIIQQ", B.CHROM_TREE, len(chroms), key, 8, len(chroms), 0) + struct.pack("<BBH", 1, 0, len(chroms))
    for i, (c, n) in enumerate(chroms.items()):
        tree += c.encode().ljust(key, b"\0") + struct.pack("<II", i, n)
    data_at = tree_at + len(tree)
    data, leaves = struct.pack("<I", len(blocks)), []
    for kind, c, rows in blocks:
        lo, hi = min(r[0] for r in rows), max(r[1] for r in rows)
        span, step = rows[0][1] - rows[0][0], (rows[1][0] - rows[0][0]) if len(rows) > 1 else 1
        raw = struct.pack("<IIIIIBBH", c, lo, hi, step, span, kind, 0, len(rows))
        for s, e, v in rows:
            raw += {1: struct.pack("<IIf", s, e, v), 2: struct.pack("<If", s, v), 3: struct.pack("<f", v)}[kind]
        z = zlib.compress(raw) if packed else raw
        leaves.append((c, lo, c, hi, data_at + len(data), len(z)))
        data += z
    index_at = data_at + len(data)
    index = struct.pack("<IIQIIIIQII", B.RANGE_TREE, 256, len(blocks), 0, 0, 9, 9, index_at, 1, 0) + struct.pack("<BBH", 1, 0, len(leaves))
    index += b"".join(struct.pack("<IIIIQQ", *x) for x in leaves)
    return struct.pack("<IHHQQQHHQQIQ", B.BIGWIG, 4, 0, tree_at, data_at, index_at, 0, 0, 0, 0, 32768 if packed else 0, 0) + tree + data + index + b"\0" * (head - 64)


@pytest.mark.parametrize("packed", [True, False])
def test_bigwig(spark, tmp_path, packed):
    B.register(spark)
    blocks = [(1, 0, [(0, 5, 1.0), (7, 9, 2.0)]), (2, 0, [(100, 103, 3.0), (110, 113, 4.0)]), (3, 1, [(10, 12, 5.0), (20, 22, 6.0), (30, 32, 7.0)])]
    p = put(tmp_path, "x.bw", bigwig({"chr1": 1000, "chr22": 500}, blocks, packed))
    names = ["chr1", "chr22"]
    want = sorted((names[c], s, e, v) for _, c, rows in blocks for s, e, v in rows)
    df = spark.read.format("bigwig").option("path", p).option("blocksPerTask", "1").load()
    assert sorted(tuple(r) for r in df.collect()) == want
    assert sorted(tuple(r) for r in df.where("chrom = 'chr1' and start_pos < 105 and end_pos > 8").collect()) == [("chr1", 7, 9, 2.0), ("chr1", 100, 103, 3.0)]
    big = B.BigFile(p, B.BIGWIG)
    assert len(big.leaves({0}, 50, 60)) == 0 and len(big.leaves({0}, 0, 60)) == 1 and len(big.leaves(None, 0, 1)) == 3


def test_trees_and_matrices(spark):
    edges = Q.parse_newick("((a:1,'b c':2)ab:0.5,'it''s',(d,e));")
    assert edges[0][1] is None and {e[2]: e[3] for e in edges if e[2]} == {"a": 1.0, "b c": 2.0, "ab": 0.5, "it's": None, "d": None, "e": None}
    parent = {e[2]: e[1] for e in edges}
    assert parent["a"] == parent["b c"] and parent["d"] == parent["e"] != parent["it's"] == 0
    for bad in ("((a,b);", "a)b;"):
        with pytest.raises(ValueError):
            Q.parse_newick(bad)
    m = Q.parse_tree_model("ALPHABET: A C G T \nORDER: 0\nSUBST_MOD: HKY85\nBACKGROUND: 0.2 0.3 0.3 0.2 \nRATE_MAT:\n 1 2 3 4\n 1 2 3 4\n 1 2 3 4\n 5 6 7 8\nTREE: (a,b);\n")
    assert m["alphabet"] == ("A", "C", "G", "T") and m["matrix"][3].tolist() == [5, 6, 7, 8] and m["tree"] == "(a,b);"
    ((name, counts),) = Q.read_pwm(">m1 x\n1 2 3 4\n5 6 7 8\n")
    assert name == "m1" and np.array_equal(counts, [[1, 2, 3, 4], [5, 6, 7, 8]])


def test_transfac(spark, tmp_path):
    t = "VV  x\n//\nAC  M1\nXX\nID  id1\nNA  nm\nDE  a thing\nBF  f1\nBF  f2\nP0      A      C      G      T\n01      1      2      3      4      N\n02      4      3      2      1      N\nXX\n//\n"
    r = Q.read_transfac(spark, put(tmp_path, "x.dat", t)).collect()
    assert [(x["accession"], x["motif_id"], x["name"], x["factors"], x["counts"]) for x in r] == [("M1", "id1", "nm", ["f1", "f2"], [[1, 2, 3, 4], [4, 3, 2, 1]])]


def test_lav_and_epo_and_gff(spark, tmp_path):
    lav = '#:lav\nd {\n  "x"\n}\ns {\n  "a.fa" 1 100 0 1\n  "b.fa-" 1 90 1 1\n}\nh {\n   ">apple"\n   ">orange (reverse complement)"\n}\na {\n  s 50\n  b 11 21\n  e 30 40\n  l 11 21 15 25 80\n  l 18 26 30 38 90\n}\n#:eof\n'
    got = [tuple(r) for r in X.read_lav_pieces(spark, put(tmp_path, "x.lav", lav)).collect()]
    assert got == [(0, 50.0, "apple", 10, 15, "+", "orange", 20, 25, "-", 80), (0, 50.0, "apple", 17, 30, "+", "orange", 25, 38, "-", 90)]
    epo = put(tmp_path, "x.out", "homo_sapiens 5 1 100 109 1 4MD6M\nmus 5 2 1 9 -1 4M2D6M\n\nmus 6 X 1 9 -1 9M\n")
    assert sorted((r["gabid"], r["strand"]) for r in X.read_epo(spark, epo).collect()) == [("5", "+"), ("6", "-")]
    from pyspark.sql import functions as F

    m = spark.range(1).select(X.cigar_matches(F.lit("3M2DM4D2M"), F.lit(10)).alias("m")).collect()[0]["m"]
    assert [tuple(x) for x in m] == [(10, 13), (15, 16), (20, 22)]
    gff = put(tmp_path, "x.gff", '##x\nchr1\ts\texon\t11\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t";\n')
    assert [tuple(r) for r in X.read_features(spark, gff).collect()] == [("chr1", "exon", 10, 20, "+", "g1")]


def test_lav_round_trip(spark, tmp_path):
    rows = [(1, 0, "ap", 10, 7, "+", 40, "ACGT--ACG", 50.0), (1, 1, "or", 3, 8, "-", 30, "ACTTGG-CG", 50.0), (2, 0, "ap", 20, 2, "+", 40, "AC", 5.0), (2, 1, "or", 20, 2, "-", 30, "AC", 5.0)]
    c = spark.createDataFrame(rows, "block_id int, comp_no int, src string, start_pos bigint, aln_size bigint, strand string, src_size bigint, text string, score double")
    K.lav_blocks(c).select("value").write.text(str(tmp_path / "lav"))
    pieces = X.read_lav_pieces(spark, str(tmp_path / "lav"))
    got = sorted(tuple(r)[2:] for r in pieces.collect())
    assert got == [("ap", 10, 14, "+", "or", 3, 7, "-", 75), ("ap", 15, 17, "+", "or", 9, 11, "-", 100), ("ap", 20, 22, "+", "or", 20, 22, "-", 100)]
    from strandlake.functions.sequence import reverse_complement

    ap = "N" * 10 + "ACGTACG" + "NNN" + "AC" + "N" * 18
    rc = "NNN" + "ACTTGGCG" + "N" * 9 + "AC" + "N" * 8
    df = spark.createDataFrame([("ap", ap), ("or", rc)], "name string, t string")
    from pyspark.sql import functions as F

    seqs = df.select("name", F.when(F.col("name") == "or", reverse_complement(F.col("t"))).otherwise(F.col("t")).alias("text"))
    texts = sorted((r["start1"], r["text1"], r["text2"]) for r in X.lav_texts(pieces, seqs).collect())
    # Between pieces the first sequence's bases come first.
    assert texts == [(10, "ACGTA--CG", "ACTT-GGCG"), (20, "AC", "AC")]
    with pytest.raises(Exception, match="no sequence"):
        X.lav_texts(pieces, seqs.where("name = 'ap'")).collect()
    ns = X.lav_texts(pieces, seqs.where("name = 'ap'"), fail_to_ns=True).where("start1 = 20").collect()[0]
    assert (ns["text1"], ns["text2"]) == ("AC", "NN")
