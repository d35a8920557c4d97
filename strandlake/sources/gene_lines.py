"""Lines of BED12 gene files: typed gene records, and the lines that can't be read with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import with_once
from strandlake.sources.rows import Field, RowSchema, integers, with_new_names

_INT = {"kind": "integer", "reason": "integer"}
_LIST = {"kind": "integers", "reason": "integer"}
BED12 = RowSchema(
    (
        Field("chrom"), Field("chrom_start", **_INT), Field("chrom_end", **_INT), Field("name"), Field("score", **_INT),
        Field("strand", "choice", r"+\-.", "strand"), Field("cds_start", **_INT), Field("cds_end", **_INT), Field("item_rgb"),
        Field("block_count", **_INT), Field("block_sizes", **_LIST), Field("block_starts", **_LIST),
    ),
    ("integer", "strand"),
)
ADDED = ["reason", "broken_field", *[f.name for f in BED12.fields]]


def read_gene_lines(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    """All records among the lines, with ``reason`` and ``broken_field`` or, where reason is null, typed fields.

    One trailing carriage return is not part of a line. Null lines, lines of blanks and tabs, and lines
    that begin with ``#``, ``track `` or ``browser `` are no records and don't come out. Reasons, the
    first that applies: quoting, columns, integer, strand, blocks, range. Repeated lines stay repeated.
    Other input columns are kept; one whose name is that of a new column is prefixed with ``in_``.
    """
    kept = with_new_names(lines, ADDED)
    line = next(c for c, old in zip(kept.columns, lines.columns) if old == line)
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    records = kept.withColumn("_sl_text", text).where(
        F.col("_sl_text").isNotNull() & ~F.col("_sl_text").rlike(r"\A(?:[ \t]*+\z|#|track |browser )")
    )
    checked = with_once(records, "_sl_bad", BED12.failure(F.col("_sl_text")))
    typed = with_once(checked, "_sl_v", F.when(F.col("_sl_bad").isNull(), BED12.values(F.col("_sl_text"))))
    for i, f in enumerate(BED12.fields):
        v = F.col("_sl_v")[i]
        typed = typed.withColumn(f.name, integers(v) if f.kind == "integers" else v.cast("bigint") if f.kind == "integer" else v)
    length = F.col("chrom_end") - F.col("chrom_start")
    pairs = F.arrays_zip(F.col("block_sizes").alias("size"), F.col("block_starts").alias("start"))
    outside = F.exists(pairs, lambda p: (p["start"] < 0) | (p["size"] < 1) | (p["size"] > length - p["start"]))
    n = F.col("block_count")
    meaning = (
        F.when((F.size("block_sizes") != n) | (F.size("block_starts") != n), F.lit("blocks"))
        .when(
            (F.col("chrom_start") < 0) | (F.col("chrom_start") >= F.col("chrom_end")) | (F.col("cds_start") < F.col("chrom_start"))
            | (F.col("cds_end") < F.col("cds_start")) | (F.col("cds_end") > F.col("chrom_end")),
            F.lit("range"),
        )
        .when(outside, F.lit("range"))
    )
    out = with_once(typed, "reason", F.coalesce(F.col("_sl_bad")["reason"], F.when(F.col("_sl_bad").isNull(), meaning)))
    out = out.withColumn("broken_field", F.col("_sl_bad")["field"])
    typed_only = [F.when(F.col("reason").isNull(), F.col(f.name)).alias(f.name) for f in BED12.fields]
    return out.select(*kept.columns, "reason", "broken_field", *typed_only)


def failed_lines(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    return read_gene_lines(lines, line).where("reason is not null")


def gene_records(lines: DataFrame, line: str = "raw_line") -> DataFrame:
    return read_gene_lines(lines, line).where("reason is null").drop("reason", "broken_field")
