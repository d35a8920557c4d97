"""Writers. Each renders lines or blocks as a column, so that ``df.write.text`` does the rest in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.sources.text import render


def write_lines(df: DataFrame, columns: Sequence[str], path: str, missing: str = ".") -> None:
    df.select(render([F.col(c) for c in columns], missing).alias("value")).write.text(path)


def write_bed(df: DataFrame, path: str, extra: Sequence[str] = ()) -> None:
    write_lines(df, ["chrom", "start_pos", "end_pos", *extra], path)


def _pad(value: Column, width: Column, left: bool) -> Column:
    text = value.cast("string")
    space = F.repeat(F.lit(" "), F.greatest(width - F.length(text), F.lit(0)))
    return F.concat(space, text) if left else F.concat(text, space)


def maf_blocks(components: DataFrame) -> DataFrame:
    """block_id and text of every block: an ``a`` line, then aligned ``s`` lines (and ``i``, ``e``, ``q`` lines where they are known)."""
    names = components.columns
    has = lambda c: F.col(c) if c in names else F.lit(None).cast("string")
    cells = ["src", "start_pos", "aln_size", "strand", "src_size"]
    wide = F.struct(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in cells])
    w = components.groupBy("block_id").agg(wide.alias("w"))
    j = components.join(w, "block_id")
    col = lambda c: _pad(F.coalesce(F.col(c).cast("string"), F.lit(".")), F.col("w")[c], c != "src")
    head = F.concat_ws(" ", *[col(c) for c in cells])
    s_line = F.concat(F.lit("s "), head, F.lit(" "), F.col("text"))
    i_line = F.when(
        has("left_status").isNotNull() & has("right_status").isNotNull(),
        F.concat_ws(" ", F.lit("i"), "src", has("left_status"), F.coalesce(has("left_len").cast("string"), F.lit("0")), has("right_status"), F.coalesce(has("right_len").cast("string"), F.lit("0"))),
    )
    q_line = F.when(has("quality").isNotNull(), F.concat_ws(" ", F.lit("q"), "src", has("quality")))
    e_line = F.when(has("empty_status").isNotNull(), F.concat(F.lit("e "), head, F.lit(" "), has("empty_status")))
    line = F.when(F.col("text").isNotNull(), F.concat_ws("\n", s_line, q_line, i_line)).otherwise(e_line)
    score = F.max(has("score").cast("double")) if "score" in names else F.lit(None).cast("double")
    first = [c for c in ("comp_no", "comp_id") if c in names]
    body = j.where(line.isNotNull()).groupBy("block_id").agg(score.alias("score"), F.sort_array(F.collect_list(F.struct(*first, line.alias("l")))).alias("b"))
    top = F.concat(F.lit("a"), F.coalesce(F.concat(F.lit(" score="), F.col("score").cast("string")), F.lit("")))
    return body.select("block_id", F.concat_ws("\n", top, F.array_join(F.transform("b", lambda x: x["l"]), "\n"), F.lit("")).alias("value"))


def write_maf(components: DataFrame, path: str) -> None:
    maf_blocks(components).select("value").write.text(path, lineSep="\n")


def axt_blocks(components: DataFrame) -> DataFrame:
    """block_id and text of blocks of exactly two components; turned so that the first lies on ``+``; 1-based, closed."""
    two = components.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("comp_no", "src", "start_pos", "aln_size", "strand", "src_size", "text"))).alias("c"))
    two = two.where((F.size("c") == 2) & F.forall("c", lambda x: x["text"].isNotNull()))
    turn = F.col("c")[0]["strand"] == "-"

    def side(i: int) -> list[Column]:
        c = F.col("c")[i]
        start = F.when(turn, c["src_size"] - c["start_pos"] - c["aln_size"]).otherwise(c["start_pos"])
        return [c["src"], start + 1, start + c["aln_size"]]

    strand = F.when(turn, F.when(F.col("c")[1]["strand"] == "-", "+").otherwise("-")).otherwise(F.col("c")[1]["strand"])
    text = lambda i: F.when(turn, S.reverse_complement(F.col("c")[i]["text"])).otherwise(F.col("c")[i]["text"])
    head = F.concat_ws(" ", F.col("block_id").cast("string"), *[x.cast("string") for x in side(0)], *[x.cast("string") for x in side(1)], strand, F.lit("0"))
    return two.select("block_id", F.concat_ws("\n", head, text(0), text(1), F.lit("")).alias("value"))


def fasta_records(df: DataFrame, name: str, text: str, width: int = 60) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), S.wrap(F.col(text), width)).alias("value"))


def maf_to_fasta(components: DataFrame, width: int = 60) -> DataFrame:
    head = F.concat(F.col("src"), F.lit("("), F.col("strand"), F.lit("):"), F.col("start_pos").cast("string"), F.lit("-"), (F.col("start_pos") + F.col("aln_size")).cast("string"))
    return fasta_records(components.where(F.col("text").isNotNull()).withColumn("_sl_h", head), "_sl_h", "text", width)


def transfac_records(motifs: DataFrame) -> DataFrame:
    """The text of every motif (accession, motif_id, name, description, counts: rows of A C G T); null fields have no line."""
    line = lambda tag, c: F.concat(F.lit(f"{tag}  "), F.col(c))
    row = lambda r, i: F.concat(F.lpad((i + 1).cast("string"), 2, "0"), F.lit(" "), F.array_join(F.transform(r, lambda v: v.cast("string")), " "))
    heads = [line("AC", "accession"), F.lit("XX"), line("ID", "motif_id"), F.lit("XX"), line("NA", "name"), line("DE", "description")]
    body = F.array_join(F.transform("counts", row), "\n")
    return motifs.select(F.concat_ws("\n", *heads, F.lit("P0 A C G T"), body, F.lit("XX"), F.lit("//")).alias("value"))


def bed12(df: DataFrame, key: str, chrom: str = "chrom") -> DataFrame:
    """One BED12 line per key from its pieces (chrom, start_pos, end_pos), in position order."""
    p = df.groupBy(key, chrom).agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos"))).alias("p"), F.min("start_pos").alias("s"), F.max("end_pos").alias("e"))
    sizes = F.array_join(F.transform("p", lambda x: (x["end_pos"] - x["start_pos"]).cast("string")), ",")
    starts = F.array_join(F.transform("p", lambda x: (x["start_pos"] - F.col("s")).cast("string")), ",")
    cells = [F.col(chrom), F.col("s"), F.col("e"), F.col(key), F.lit(1000), F.lit("+"), F.col("s"), F.col("e"), F.lit("0,0,0"), F.size("p"), sizes, starts]
    return p.select(render(cells).alias("value"))


def write_ranged(df: DataFrame, path: str, n_files: int | None = None) -> None:
    """An interval table laid out for range lookups: files hold ranges of (chrom, start), so row groups are skipped by their extremes."""
    by = ["chrom", "start_pos"]
    spread = df.repartitionByRange(n_files, *by) if n_files else df.repartitionByRange(*by)
    spread.sortWithinPartitions(*by, "end_pos").write.parquet(path)


def write_by_source(components: DataFrame, path: str) -> None:
    """One folder for each source."""
    components.repartition("src").write.partitionBy("src").parquet(path)


def lav_blocks(components: DataFrame) -> DataFrame:
    """src1, strand1, src2, strand2 and the LAV text of all pairs of two sequences: one header, then an ``a`` stanza a block.

    A piece is a run of columns without a gap; its percentage is (200 matches + size) div (2 size).
    """
    two = components.groupBy("block_id").agg(
        F.max("score").alias("score") if "score" in components.columns else F.lit(0.0).alias("score"),
        F.sort_array(F.collect_list(F.struct("comp_no", "src", "start_pos", "aln_size", "strand", "src_size", F.upper("text").alias("text")))).alias("c"),
    )
    two = two.where((F.size("c") == 2) & F.forall("c", lambda x: F.length(x["text"]) > 0))
    a, b = F.col("c")[0], F.col("c")[1]
    pairs = F.zip_with(S.chars(a["text"]), S.chars(b["text"]), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    each = two.select("block_id", "score", "c", F.posexplode(pairs).alias("i", "p"))
    upto = Window.partitionBy("block_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    full = (F.col("p.x") != "-") & (F.col("p.y") != "-")
    placed = each.withColumns(
        {"n1": F.sum((F.col("p.x") != "-").cast("int")).over(upto), "n2": F.sum((F.col("p.y") != "-").cast("int")).over(upto),
         "run": F.sum((~full).cast("int")).over(upto), "full": full}
    )
    runs = placed.where("full").groupBy("block_id", "score", "c", "run").agg(
        F.min("n1").alias("a1"), F.max("n1").alias("e1"), F.min("n2").alias("a2"), F.max("n2").alias("e2"), F.count("*").alias("n"), F.sum((F.col("p.x") == F.col("p.y")).cast("int")).alias("m")
    )
    pct = F.expr("(200 * m + n) div (2 * n)")
    at = lambda k, i: F.col(k) + F.col("c")[i]["start_pos"]
    line = F.format_string("  l %d %d %d %d %d", at("a1", 0), at("a2", 1), at("e1", 0), at("e2", 1), pct)
    stanza = runs.groupBy("block_id", "score", "c").agg(F.sort_array(F.collect_list(F.struct("a1", line.alias("l")))).alias("l"))
    span = lambda i, end: F.col("c")[i]["start_pos"] + (F.col("c")[i]["aln_size"] if end else 1)
    body = F.concat_ws(
        "\n", F.lit("a {"), F.format_string("  s %.0f", F.coalesce("score", F.lit(0.0))), F.format_string("  b %d %d", span(0, 0), span(1, 0)),
        F.format_string("  e %d %d", span(0, 1), span(1, 1)), F.array_join(F.transform("l", lambda x: x["l"]), "\n"), F.lit("}"),
    )
    key = {f"{k}{i + 1}": F.col("c")[i][k] for i in (0, 1) for k in ("src", "strand", "src_size")}
    named = stanza.select("block_id", *[v.alias(k) for k, v in key.items()], body.alias("t"))
    file = lambda i: F.format_string('  "%s%s" 1 %d %s 1', F.col(f"src{i}"), F.when(F.col(f"strand{i}") == "-", "-").otherwise(""), F.col(f"src_size{i}"), F.when(F.col(f"strand{i}") == "-", "1").otherwise("0"))
    name = lambda i: F.format_string('  ">%s%s"', F.col(f"src{i}"), F.when(F.col(f"strand{i}") == "-", " (reverse complement)").otherwise(""))
    head = F.concat_ws("\n", F.lit("#:lav"), F.lit("s {"), file(1), file(2), F.lit("}"), F.lit("h {"), name(1), name(2), F.lit("}"))
    grouped = named.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("block_id", "t"))).alias("b"))
    text = F.concat_ws("\n", head, F.array_join(F.transform("b", lambda x: x["t"]), "\n"), F.lit("#:eof"))
    return grouped.select("src1", "strand1", "src2", "strand2", text.alias("value"))
