"""Block-oriented text: alignments (MAF, AXT, LAV, EPO) and chains. Files split between tasks; line ends may be of either kind."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.sequence import reverse_complement
from strandlake.session import small_side, stage, with_once


def _records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """block_id, head and lines of the blocks whose first line begins with ``mark``, up to an empty or blank line.

    ``head`` is the first line without its mark. A line end and the mark divide the records of the
    scan, so nothing is shuffled; ids are unique, in no promised order. Comment lines are left out.
    """
    raw = spark.read.text(path, lineSep=f"\n{mark}").where(F.rlike("value", F.lit(rf"\A(?:{mark})?(?:\s|\z)")))
    unix = F.regexp_replace(F.regexp_replace("value", r"\r(?=\n|\z)", ""), rf"\A{mark}", "")
    block = F.split(unix, r"\n[ \t]*(?:\n|\z)", 2)[0]
    lines = with_once(raw.select(F.monotonically_increasing_id().alias("block_id"), block.alias("_sl_b")), "lines", F.split("_sl_b", "\n"))
    rest = F.filter(F.slice("lines", F.lit(2), F.size("lines")), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#")))
    return lines.select("block_id", F.trim(F.col("lines")[0]).alias("head"), rest.alias("lines"))


def _headed_blocks(spark: SparkSession, path: str, header: str) -> DataFrame:
    """block_id and lines of the blocks that begin at lines like ``header``; lines before the first one are left out.

    Lines are counted within each split of a file as they are read; the splits' counts are put together
    afterwards, one row a split.
    """
    pattern = header

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, local, line = None, 0, 0
        for batch in batches:
            at = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            starts = pc.fill_null(pc.match_substring_regex(batch.column(0), pattern), False).to_numpy(zero_copy_only=False)
            no, order = np.zeros(len(at), "int64"), np.zeros(len(at), "int64")
            for i, own in enumerate(at):
                if own != where:
                    where, local, line = own, 0, 0
                local += bool(starts[i])
                line += 1
                no[i], order[i] = local, line
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(no), pa.array(order)], names=["value", "file", "split", "local", "line"])

    text = spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    kept = text.where(~F.startswith("value", F.lit("#")))
    lines = stage(kept.mapInArrow(work, "value string, file string, split bigint, local bigint, line bigint"), "lines")
    splits = lines.df.groupBy("file", "split").agg(F.max("local").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(splits.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "splits").df
    numbered = lines.df.join(small_side(offsets, offsets.count()), ["file", "split"]).withColumn("no", F.col("offset") + F.col("local"))
    found = numbered.where((F.col("no") > 0) & (F.trim("value") != "")).groupBy("file", "no").agg(F.sort_array(F.collect_list(F.struct("split", "line", "value"))).alias("x"))
    return found.select(F.xxhash64("file", "no").alias("block_id"), F.col("x.value").alias("lines"))


def read_maf(spark: SparkSession, path: str, *, e_rows: bool = True) -> DataFrame:
    """One row a component: block_id, score, comp_no, src, start_pos, aln_size, strand, src_size, text, quality,
    left/right status and length, empty_status."""
    rec = _records(spark, path, "a")
    score = F.regexp_extract("head", r"score=(\S+)", 1)
    each = rec.select("block_id", "lines", F.when(score != "", score.try_cast("double")).alias("score"), F.posexplode("lines").alias("i", "line"))
    kinds = "[se]" if e_rows else "s"
    each = with_once(each.where(F.rlike("line", F.lit(rf"\A{kinds}\s"))), "c", F.split(F.trim("line"), r"\s+"))
    # Rows of neighbours and qualities follow their sequence's row directly.
    own = lambda x: F.rlike(x, F.lit(r"\A[iq]\s")) & (F.split(F.trim(x), r"\s+")[1] == F.col("c")[1])
    one, two = (F.get("lines", F.col("i") + k) for k in (1, 2))
    near = F.filter(F.array(F.when(own(one), one), F.when(own(one) & own(two), two)), lambda x: x.isNotNull())
    info = with_once(each, "n", near)
    i_row = F.split(F.trim(F.get(F.filter("n", lambda x: F.startswith(x, F.lit("i"))), F.lit(0))), r"\s+")
    q_row = F.get(F.filter("n", lambda x: F.startswith(x, F.lit("q"))), F.lit(0))
    c, is_s = F.col("c"), F.col("c")[0] == "s"
    # Components before this one in the block.
    no = F.size(F.filter(F.slice("lines", F.lit(1), F.col("i")), lambda x: F.rlike(x, F.lit(rf"\A{kinds}\s"))))
    return info.select(
        "block_id", "score", no.alias("comp_no"), c[1].alias("src"), c[2].cast("bigint").alias("start_pos"), c[3].cast("bigint").alias("aln_size"),
        c[4].alias("strand"), c[5].cast("bigint").alias("src_size"), F.when(is_s, c[6]).alias("text"),
        F.when(q_row.isNotNull(), F.split(F.trim(q_row), r"\s+")[2]).alias("quality"),
        F.get(i_row, F.lit(2)).alias("left_status"), F.get(i_row, F.lit(3)).cast("bigint").alias("left_len"), F.get(i_row, F.lit(4)).alias("right_status"),
        F.get(i_row, F.lit(5)).cast("bigint").alias("right_len"), F.when(~is_s, c[6]).alias("empty_status"),
    )


def read_axt(spark: SparkSession, path: str, *, lengths: DataFrame | None = None) -> DataFrame:
    """Components 0 and 1 of every pair, zero-based half-open. Source sizes come from lengths (name, length)."""
    blocks = _headed_blocks(spark, path, r"^\s*[0-9]+\s+\S+\s+[0-9]+\s+[0-9]+\s+\S+\s+[0-9]+\s+[0-9]+\s+[-+]")
    rec = with_once(blocks.where(F.size("lines") >= 3), "h", F.split(F.trim(F.col("lines")[0]), r"\s+"))
    h = F.col("h")
    comp = lambda no, a, strand, line: F.struct(
        F.lit(no).alias("comp_no"), h[a].alias("src"), (h[a + 1].cast("bigint") - 1).alias("start_pos"),
        (h[a + 2].cast("bigint") - h[a + 1].cast("bigint") + 1).alias("aln_size"), strand.alias("strand"), F.trim(F.col("lines")[line]).alias("text"),
    )
    out = rec.select("block_id", F.get(h, F.lit(8)).cast("double").alias("score"), F.inline(F.array(comp(0, 1, F.lit("+"), 1), comp(1, 4, h[7], 2))))
    if lengths is None:
        return out.withColumn("src_size", F.lit(None).cast("bigint"))
    return out.join(lengths.select(F.col("name").alias("src"), F.col("length").alias("src_size")), "src", "left")


def read_chains(spark: SparkSession, path: str) -> DataFrame:
    """One row a chain with arrays sizes, dt, dq; a chain whose blocks don't add up fails the query."""
    rows = with_once(_records(spark, path, "chain"), "h", F.split("head", r"\s+"))
    steps = F.transform("lines", lambda x: F.split(F.trim(x), r"\s+"))
    rows = with_once(rows, "st", steps)
    num = lambda i: F.transform("st", lambda s: F.coalesce(F.get(s, F.lit(i)).cast("bigint"), F.lit(0)))
    h = F.col("h")
    out = rows.select(
        h[11].alias("chain_id"), h[0].cast("double").alias("score"), h[1].alias("t_name"), h[2].cast("bigint").alias("t_size"), h[3].alias("t_strand"),
        h[4].cast("bigint").alias("t_start"), h[5].cast("bigint").alias("t_end"), h[6].alias("q_name"), h[7].cast("bigint").alias("q_size"),
        h[8].alias("q_strand"), h[9].cast("bigint").alias("q_start"), h[10].cast("bigint").alias("q_end"), num(0).alias("sizes"), num(1).alias("dt"), num(2).alias("dq"),
    )
    total = lambda *cs: F.aggregate(F.concat(*cs), F.lit(0).cast("bigint"), lambda s, v: s + v)
    fits = (total("sizes", "dt") == F.col("t_end") - F.col("t_start")) & (total("sizes", "dq") == F.col("q_end") - F.col("q_start"))
    return out.withColumn("chain_id", F.when(fits, F.col("chain_id")).otherwise(F.raise_error(F.lit("a chain's blocks don't add up")).cast("string")))


def read_epo(spark: SparkSession, path: str) -> DataFrame:
    """species, gabid, chrom, start_pos, end_pos (1-based, closed), strand, cigar of rows whose span is the sum of their matches."""
    c = F.split(F.trim("value"), r"\s+")
    rows = with_once(spark.read.text(path), "c", c).where(F.size("c") >= 7)
    parts = F.regexp_extract_all(F.col("c")[6], F.lit(r"(\d*)M"), F.lit(1))
    m = F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, v: s + F.when(v == "", F.lit(1)).otherwise(v.try_cast("bigint")))
    c = F.col("c")
    out = rows.select(
        c[0].alias("species"), c[1].alias("gabid"), c[2].alias("chrom"), c[3].cast("bigint").alias("start_pos"), c[4].cast("bigint").alias("end_pos"),
        F.when(c[5] == "1", "+").otherwise("-").alias("strand"), c[6].alias("cigar"), m.alias("_sl_m"),
    )
    return out.where(F.col("end_pos") - F.col("start_pos") + 1 == F.col("_sl_m")).drop("_sl_m")


def cigar_matches(cigar, start):
    """Match intervals of a cigar column, in order, from ``start``: gaps (D) take room, matches (M) come out."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d*[MDI])"), F.lit(1))
    zero = F.struct(start.cast("bigint").alias("p"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"))

    def add(state, part):
        n = F.when(F.length(part) == 1, F.lit(1)).otherwise(F.expr("1") * F.regexp_extract(part, r"(\d+)", 1).try_cast("bigint"))
        end = state["p"] + n
        return F.struct(
            end.alias("p"),
            F.when(F.endswith(part, F.lit("M")), F.concat(state["out"], F.array(F.struct(state["p"].alias("s"), end.alias("e"))))).otherwise(state["out"]).alias("out"),
        )

    return F.aggregate(parts, zero, add, lambda s: s["out"])


def _lav_pieces(text: str) -> Iterator[tuple]:
    names, strands, starts, block = [("", 0), ("", 0)], ["+", "+"], [1, 1], -1
    for kind, body in re.findall(r"(?ms)^([a-z])\s*\{\n(.*?)^\}", text):
        lines = [x.strip() for x in body.strip().split("\n")]
        if kind == "s":
            for i, x in enumerate(lines[:2]):
                m = re.match(r'"([^"]*)"\s+(\d+)\s+(\d+)\s+(\d+)', x)
                strands[i] = "-" if m[1].endswith("-") or m[4] == "1" else "+"
                names[i], starts[i] = (m[1].rstrip("-"), int(m[3])), int(m[2])
        elif kind == "h":
            for i, x in enumerate(lines[:2]):
                name = x.strip('"').split(" (reverse complement)")[0].lstrip(">")
                names[i] = (name or names[i][0], names[i][1])
        elif kind == "a":
            block += 1
            score = next((float(x.split()[1]) for x in lines if x.startswith("s ")), None)
            for x in lines:
                if x.startswith("l "):
                    s1, s2, e1, e2, pct = map(int, x.split()[1:6])
                    yield block, score, names[0][0], s1 + starts[0] - 2, e1 + starts[0] - 1, strands[0], names[1][0], s2 + starts[1] - 2, e2 + starts[1] - 1, strands[1], pct


def read_lav_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Gap-free pieces of LAV files, zero-based half-open. Stanzas depend on those before them, so each file is one task."""
    schema = "block int, score double, src1 string, start1 bigint, end1 bigint, strand1 string, src2 string, start2 bigint, end2 bigint, strand2 string, pct int"
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame(_lav_pieces(text), columns=names)

    return spark.read.text(path, wholetext=True).mapInPandas(work, schema)


def lav_texts(pieces: DataFrame, sequences: DataFrame, *, fail_to_ns: bool = False) -> DataFrame:
    """block, score, src1, src2, start1, start2, text1, text2: the pieces of each alignment with what lies between them.

    sequences are rows of (name, text). Positions on strand - count from the sequence's end. A sequence
    that isn't there is an error, or Ns if ``fail_to_ns``.
    """
    along = Window.partitionBy("block").orderBy("start1", "start2")
    p = pieces.withColumns({"next1": F.coalesce(F.lead("start1").over(along), "end1"), "next2": F.coalesce(F.lead("start2").over(along), "end2")})
    for i in (1, 2):
        named = sequences.select(F.col("name").alias(f"src{i}"), F.col("text").alias(f"_sl_t{i}"))
        p = p.join(named, f"src{i}", "left")
        whole = F.when(F.col(f"strand{i}") == "-", reverse_complement(F.col(f"_sl_t{i}"))).otherwise(F.col(f"_sl_t{i}"))
        n = F.col(f"next{i}") - F.col(f"start{i}")
        absent = F.repeat(F.lit("N"), n.cast("int")) if fail_to_ns else F.raise_error(F.concat(F.lit("no sequence "), F.col(f"src{i}"))).cast("string")
        p = p.withColumn(f"_sl_p{i}", F.when(whole.isNull(), absent).otherwise(F.substring(whole, (F.col(f"start{i}") + 1).cast("int"), n.cast("int")))).drop(f"_sl_t{i}")
    own = F.col("end1") - F.col("start1")
    gap1, gap2 = (F.repeat(F.lit("-"), F.greatest(F.col(f"next{i}") - F.col(f"end{i}"), F.lit(0)).cast("int")) for i in (1, 2))
    head = lambda i: F.substring(f"_sl_p{i}", F.lit(1), own.cast("int"))
    rest = lambda i: F.substring(f"_sl_p{i}", (own + 1).cast("int"), F.length(f"_sl_p{i}"))
    # Between two pieces the first sequence's bases come before the second one's.
    part = F.struct("start1", "start2", F.concat(head(1), rest(1), gap2).alias("t1"), F.concat(head(2), gap1, rest(2)).alias("t2"))
    out = p.groupBy("block", "score", "src1", "src2").agg(F.sort_array(F.collect_list(part)).alias("p"))
    text = lambda t: F.array_join(F.transform("p", lambda x: x[t]), "")
    return out.select("block", "score", "src1", "src2", F.col("p")[0]["start1"].alias("start1"), F.col("p")[0]["start2"].alias("start2"), text("t1").alias("text1"), text("t2").alias("text2"))


def read_features(spark: SparkSession, path: str, *, group: str = r'(?:gene_id|transcript_id|Parent=|ID=)\s*"?([^";]+)') -> DataFrame:
    """chrom, feature, start_pos, end_pos (zero-based half-open), strand, group of GFF and GTF lines."""
    rows = with_once(spark.read.text(path).where(~F.startswith("value", F.lit("#"))), "c", F.split("value", "\t")).where(F.size("c") >= 9)
    c = F.col("c")
    named = F.regexp_extract(c[8], group, 1)
    return rows.select(
        c[0].alias("chrom"), c[2].alias("feature"), (c[3].try_cast("bigint") - 1).alias("start_pos"), c[4].try_cast("bigint").alias("end_pos"),
        c[6].alias("strand"), F.when(named != "", named).otherwise(F.trim(c[8])).alias("gene"),
    )
