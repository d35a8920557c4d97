"""Sequences as chunks (name, chunk_start, text), so that a slice is a range filter; motif and tree files."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.sequence import reverse_complement
from strandlake.session import with_once


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, description, text (white space removed) of every record; a file's head without a name has the name null."""
    # Records are divided where a line begins with the mark; only the first one of a file keeps it, or has no header.
    rec = spark.read.text(path, lineSep="\n>").where(F.rlike("value", F.lit(r"\S")))
    first = F.rlike("value", F.lit(r"\A\s*>"))
    bare = ~first & F.rlike("value", F.lit(r"\A[ACGTUNacgtunRYKMBDHVryksmbdhv\-\s]+\z"))
    record = F.regexp_replace("value", r"\A\s*>", "")
    whole = with_once(rec.select(record.alias("r"), bare.alias("bare")), "head", F.when(F.col("bare"), "").otherwise(F.trim(F.regexp_extract("r", r"\A([^\r\n]*)", 1))))
    body = F.when(F.col("bare"), F.col("r")).otherwise(F.regexp_replace("r", r"\A[^\n]*\n?", ""))
    name = F.split("head", r"\s+")[0]
    return whole.select(F.when(name != "", name).alias("name"), F.col("head").alias("description"), F.regexp_replace(body, r"\s+", "").alias("text"))


def chunked(sequences: DataFrame, size: int = 100_000) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.length("text") - 1, F.lit(0)).cast("bigint"), F.lit(size).cast("bigint"))
    each = sequences.select("name", "text", F.explode(starts).alias("chunk_start"))
    return each.select("name", "chunk_start", F.substring("text", (F.col("chunk_start") + 1).cast("int"), F.lit(size)).alias("text"))


def extract(chunks: DataFrame, regions: DataFrame, key: str, *, size: int = 100_000, strand: str | None = None) -> DataFrame:
    """key, text of regions (chrom, start_pos, end_pos) of chunked sequences; on strand ``-`` the reverse complement."""
    wanted = regions.where("start_pos < end_pos").select(
        key, "chrom", "start_pos", "end_pos", (F.col(strand) if strand else F.lit("+")).alias("_sl_strand"),
        F.explode(F.sequence(F.expr(f"start_pos div {size}"), F.expr(f"(end_pos - 1) div {size}"))).alias("_sl_k"),
    )
    c = chunks.select(F.col("name").alias("chrom"), "chunk_start", F.expr(f"chunk_start div {size}").alias("_sl_k"), F.col("text").alias("_sl_t"))
    low = F.greatest(F.col("start_pos") - F.col("chunk_start"), F.lit(0))
    part = F.substring("_sl_t", (low + 1).cast("int"), (F.col("end_pos") - F.col("chunk_start") - low).cast("int"))
    pieces = wanted.join(c, ["chrom", "_sl_k"]).select(key, "_sl_strand", F.struct("chunk_start", part.alias("p")).alias("s"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda x: x["p"]), "")
    out = pieces.groupBy(key, "_sl_strand").agg(text.alias("text"))
    return out.select(key, F.when(F.col("_sl_strand") == "-", reverse_complement(F.col("text"))).otherwise(F.col("text")).alias("text"))


def read_transfac(spark: SparkSession, path: str) -> DataFrame:
    """accession, motif_id, name, description, factors, counts (rows of A C G T) of every motif."""
    rec = spark.read.text(path, lineSep="//").where(F.rlike("value", F.lit(r"(?m)^(?:AC|ID|P0|PO)\s")))
    one = lambda tag: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{tag}\s+(.*)$", 1)), F.lit(""))
    rows = F.regexp_extract_all("value", F.lit(r"(?m)^(\d+\s+[0-9.\-]+\s+[0-9.\-]+\s+[0-9.\-]+\s+[0-9.\-]+)"), F.lit(1))
    counts = F.transform(rows, lambda r: F.transform(F.slice(F.split(r, r"\s+"), F.lit(2), F.lit(4)), lambda v: v.cast("double")))
    factors = F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^BF\s+(.*)$"), F.lit(1)), lambda v: F.trim(v))
    return rec.select(one("AC").alias("accession"), one("ID").alias("motif_id"), one("NA").alias("name"), one("DE").alias("description"), factors.alias("factors"), counts.alias("counts"))


def read_pwm(text: str) -> list[tuple[str, np.ndarray]]:
    """(id, matrix) of the basic format: a ``>`` line, then rows of four counts."""
    out = []
    for block in re.split(r"(?m)^>", text)[1:]:
        head, *rows = block.strip().split("\n")
        out.append((head.split()[0], np.array([[float(v) for v in r.split()[:4]] for r in rows if r.strip()])))
    return out


def parse_newick(text: str) -> list[tuple[int, int | None, str | None, float | None]]:
    """Edge table (id, parent, label, length) of a tree, root first. Labels may be quoted; '' stands for one quote."""
    tokens = re.findall(r"'(?:[^']|'')*'|[(),:;]|[^\s(),:;']+", text)
    nodes: list[list] = [[0, None, None, None]]
    here, after_colon, depth = 0, False, 0
    for t in tokens:
        if t == "(":
            nodes.append([len(nodes), here, None, None])
            here, depth = len(nodes) - 1, depth + 1
        elif t == ",":
            if not depth:
                raise ValueError("a comma outside brackets")
            nodes.append([len(nodes), nodes[here][1], None, None])
            here = len(nodes) - 1
        elif t == ")":
            if not depth:
                raise ValueError("a bracket closes that isn't open")
            here, depth = nodes[here][1], depth - 1
        elif t == ":":
            after_colon = True
        elif t == ";":
            break
        elif after_colon:
            nodes[here][3], after_colon = float(t), False
        else:
            nodes[here][2] = t[1:-1].replace("''", "'") if t.startswith("'") else t
    if depth:
        raise ValueError("a bracket isn't closed")
    return [tuple(n) for n in nodes]


def newick_edges(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_newick(text), "id int, parent int, label string, length double")


def parse_tree_model(text: str) -> dict:
    """alphabet, order, subst_mod, background, rate matrix and tree of a substitution model."""
    lines, out, i = text.split("\n"), {}, 0
    while i < len(lines):
        key, found, value = lines[i].partition(":")
        i += 1
        if not found:
            continue
        key, value = key.strip(), value.strip()
        if key == "ALPHABET":
            out["alphabet"] = tuple(value.split())
        elif key == "ORDER":
            out["order"] = int(value)
        elif key in ("SUBST_MOD", "TREE"):
            out[key.lower()] = value
        elif key == "BACKGROUND":
            out["background"] = tuple(map(float, value.split()))
        elif key == "RATE_MAT":
            n = len(out["alphabet"])
            out["matrix"] = np.array([[float(v) for v in lines[i + k].split()] for k in range(n)])
            i += n
    return out


def sequence_names(chunks: DataFrame) -> DataFrame:
    """name, length of chunked sequences."""
    return chunks.groupBy("name").agg(F.max(F.col("chunk_start") + F.length("text")).alias("length"))


