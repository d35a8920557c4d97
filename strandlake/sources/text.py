"""Line-oriented sources: delimited tables, intervals, lengths, wiggle."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.session import with_once


def read_table(spark: SparkSession, path: str, *, header: bool | Sequence[str] | None = None, comment: str = "#") -> DataFrame:
    """Tab-divided rows as strings.

    header: names, True (the first line has them), or None (the first line, if it is a comment). Comment
    and blank lines are left out. Short rows end in nulls.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("value"))
    names = list(header) if isinstance(header, (list, tuple)) else None
    first = None
    if names is None:
        got = lines.limit(1).collect()  # one line
        first = got[0][0] if got else ""
        if header or first.startswith(comment):
            names = first.removeprefix(comment).strip().split("\t")
    rows = lines.where(~F.startswith("value", F.lit(comment)) & (F.trim("value") != ""))
    if header is True:
        rows = rows.where(F.col("value") != F.lit(first))
    cells = F.split("value", "\t")
    if names is None:
        names = [f"c{i}" for i in range(len((first or "").split("\t")))]
    return rows.select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)])


def comments(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    return spark.read.text(path).where(F.startswith("value", F.lit(comment)))


def parse_intervals(
    lines: DataFrame, *, chrom: int = 0, start: int = 1, end: int = 2, strand: int | None = 5, default_strand: str = "+",
    fix_strand: bool = False, allow_spaces: bool = False, prefixes: Sequence[str] = ("#", "track ", "browser "),
) -> DataFrame:
    """chrom, start_pos, end_pos, strand, fields and ``error`` of the lines (column ``value``) that are no comments.

    Errors: missing field, start or end not a whole number, end below start, strand other than + and -
    (taken as + if ``fix_strand``).
    """
    text = F.regexp_replace("value", r"\r\z", "")
    kept = lines.select(text.alias("value")).where(F.trim("value") != "")
    for p in prefixes:
        kept = kept.where(~F.startswith("value", F.lit(p)))
    cells = F.split("value", "\t")
    if allow_spaces:
        cells = F.when(F.size(cells) > max(chrom, start, end), cells).otherwise(F.split(F.trim("value"), r"\s+"))
    rows = with_once(kept, "fields", cells)
    at = lambda i: F.get("fields", F.lit(i))
    s, e = (F.when(F.rlike(F.trim(at(i)), F.lit(r"\A-?[0-9]+\z")), F.trim(at(i)).try_cast("bigint")) for i in (start, end))
    given = at(strand) if strand is not None else F.lit(None).cast("string")
    sign = F.when(given.isNull(), F.lit(default_strand)).when(given.isin("+", "-"), given)
    if fix_strand:
        sign = F.coalesce(sign, F.lit("+"))
    error = (
        F.when(F.size("fields") <= max(chrom, start, end), F.lit("missing field"))
        .when(s.isNull(), F.lit("start is not a whole number"))
        .when(e.isNull(), F.lit("end is not a whole number"))
        .when(e < s, F.lit("end before start"))
        .when(sign.isNull(), F.lit("strand is neither + nor -"))
    )
    return rows.select(at(chrom).alias("chrom"), s.alias("start_pos"), e.alias("end_pos"), sign.alias("strand"), "fields", error.alias("error"))


def read_intervals(spark: SparkSession, path: str, *, strict: bool = False, lengths: DataFrame | None = None, **layout) -> DataFrame:
    """Intervals of a file; bad rows are left out, or fail the query if ``strict``.

    With lengths (name, length) rows that end beyond their sequence are left out too.
    """
    rows = parse_intervals(spark.read.text(path), **layout)
    if strict:
        return rows.where(F.when(F.col("error").isNull(), True).otherwise(F.raise_error(F.col("error")).cast("boolean"))).drop("error")
    good = rows.where("error is null").drop("error")
    if lengths is None:
        return good
    sizes = lengths.select(F.col("name").alias("_sl_n"), F.col("length").alias("_sl_l"))
    return good.join(sizes, F.col("chrom") == F.col("_sl_n"), "left").where(F.col("end_pos") <= F.coalesce("_sl_l", F.lit(2**62))).drop("_sl_n", "_sl_l")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start_pos, end_pos, name, score of the good rows; name and score are null where a row lacks them or has ``.``."""
    field = lambda i: F.nullif(F.get("fields", F.lit(i)), F.lit("."))
    return read_intervals(spark, path, strand=None).select("chrom", "start_pos", "end_pos", field(3).alias("name"), field(4).try_cast("double").alias("score"))


def bad_intervals(spark: SparkSession, path: str, **layout) -> DataFrame:
    return parse_intervals(spark.read.text(path), **layout).where("error is not null")


def clip(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """Starts not below 0 and ends not beyond the sequence's length (where it is known)."""
    sizes = lengths.select(F.col("name").alias("_sl_n"), F.col("length").alias("_sl_l"))
    joined = df.join(sizes, F.col("chrom") == F.col("_sl_n"), "left")
    s, e = F.greatest("start_pos", F.lit(0).cast("bigint")), F.least("end_pos", F.coalesce("_sl_l", F.lit(2**62)))
    return joined.withColumns({"start_pos": s, "end_pos": e}).drop("_sl_n", "_sl_l")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """name, length; a repeated name fails the query."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).select(cells[0].alias("name"), cells[1].cast("bigint").alias("length"))
    n = F.count("*")
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("repeated name: "), F.col("name")))).otherwise(F.max("length"))
    return rows.groupBy("name").agg(checked.alias("length"))


def _wiggle_rows(text: str) -> Iterator[tuple]:
    mode, chrom, pos, step, span = "bed", None, 0, 1, 1
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith(("#", "track", "browser")):
            continue
        if line.startswith(("variableStep", "fixedStep")):
            head = dict(x.split("=", 1) for x in line.split()[1:])
            mode, chrom, span = line.split()[0], head["chrom"], int(head.get("span", 1))
            if mode == "fixedStep":
                pos, step = int(head["start"]) - 1, int(head.get("step", 1))
            continue
        cells = line.split()
        if mode == "variableStep":
            at = int(cells[0]) - 1
            yield chrom, at, at + span, "+", float(cells[1])
        elif mode == "fixedStep":
            yield chrom, pos, pos + span, "+", float(cells[0])
            pos += step
        elif len(cells) > 3:
            yield cells[0], int(cells[1]), int(cells[2]), cells[5] if len(cells) > 5 else "+", float(cells[3])


def read_wiggle(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start_pos, end_pos, strand, value, zero-based, of bed, variableStep and fixedStep sections.

    Sections depend on the lines before them, so each file is one task.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame(_wiggle_rows(text), columns=["chrom", "start_pos", "end_pos", "strand", "value"])

    return spark.read.text(path, wholetext=True).mapInPandas(work, "chrom string, start_pos bigint, end_pos bigint, strand string, value double")


def by_position(signal: DataFrame) -> DataFrame:
    """chrom, pos, value of every base."""
    return signal.where("start_pos < end_pos").select("chrom", F.explode(F.sequence("start_pos", F.col("end_pos") - 1)).alias("pos"), "value")


def render(columns: Sequence[Column], missing: str = ".") -> Column:
    """A tab-divided line; nulls as ``missing``."""
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(missing)) for c in columns])
