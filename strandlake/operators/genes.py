"""Gene models: rows of typed BED12 records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exons(genes: DataFrame) -> DataFrame:
    """line_id, exon_no, chrom, start, end, strand of every block, in position order."""
    blocks = F.transform(
        F.arrays_zip(F.col("block_starts").alias("s"), F.col("block_sizes").alias("z")),
        lambda b: F.struct((F.col("chrom_start") + b["s"]).alias("start_pos"), (F.col("chrom_start") + b["s"] + b["z"]).alias("end_pos")),
    )
    return genes.select("line_id", "chrom", "strand", "cds_start", "cds_end", F.posexplode(F.array_sort(blocks)).alias("exon_no", "b")).select(
        "line_id", "exon_no", "chrom", "strand", "cds_start", "cds_end", F.col("b.start_pos").alias("start_pos"), F.col("b.end_pos").alias("end_pos")
    )


def _merged(blocks: Column) -> Column:
    """Sorted blocks with overlapping and touching ones joined."""

    def add(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start_pos"].alias("start_pos"), F.greatest(last["end_pos"], b["end_pos"]).alias("end_pos"))
        return (
            F.when(F.size(done) == 0, F.array(b))
            .when(b["start_pos"] <= last["end_pos"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined)))
            .otherwise(F.concat(done, F.array(b)))
        )

    return F.aggregate(blocks, F.array().cast("array<struct<start_pos:bigint,end_pos:bigint>>"), add)


def _blocks() -> Column:
    return F.array_sort(
        F.transform(
            F.arrays_zip(F.col("block_starts").alias("s"), F.col("block_sizes").alias("z")),
            lambda b: F.struct((F.col("chrom_start") + b["s"]).alias("start_pos"), (F.col("chrom_start") + b["s"] + b["z"]).alias("end_pos")),
        )
    )


def introns(genes: DataFrame) -> DataFrame:
    """line_id, chrom, start, end, strand of the stretches between a gene's exons."""
    runs = genes.select("line_id", "chrom", "strand", _merged(_blocks()).alias("m"))
    n = F.greatest(F.size("m") - 1, F.lit(0))
    between = F.zip_with(F.slice("m", F.lit(1), n), F.slice("m", F.lit(2), n), lambda a, b: F.struct(a["end_pos"].alias("start_pos"), b["start_pos"].alias("end_pos")))
    return runs.select("line_id", "chrom", "strand", F.inline(between))


def coding_exons(genes: DataFrame, *, trim: bool = True) -> DataFrame:
    """The parts of a gene's exons within its coding range; if trimmed, cut at the strand's far end to a multiple of 3 bases.

    Genes with an empty coding range have none.
    """
    clipped = F.filter(
        F.transform(
            _merged(_blocks()),
            lambda b: F.struct(F.greatest(b["start_pos"], F.col("cds_start")).alias("start_pos"), F.least(b["end_pos"], F.col("cds_end")).alias("end_pos")),
        ),
        lambda b: b["start_pos"] < b["end_pos"],
    )
    rows = genes.select("line_id", "chrom", "strand", clipped.alias("c")).withColumn(
        "total", F.aggregate("c", F.lit(0).cast("bigint"), lambda s, b: s + b["end_pos"] - b["start_pos"])
    )
    each = rows.select("line_id", "chrom", "strand", "c", "total", F.posexplode("c").alias("i", "b"))
    before = F.aggregate(F.slice("c", F.lit(1), F.col("i")), F.lit(0).cast("bigint"), lambda s, b: s + b["end_pos"] - b["start_pos"])
    after = F.col("total") - before - (F.col("b.end_pos") - F.col("b.start_pos"))
    extra = F.col("total") % 3 if trim else F.lit(0)
    # Bases still to cut when this exon is reached from the far end.
    minus = F.col("strand") == "-"
    cut = F.greatest(extra - F.when(minus, before).otherwise(after), F.lit(0))
    start = F.col("b.start_pos") + F.when(minus, cut).otherwise(0)
    end = F.col("b.end_pos") - F.when(minus, F.lit(0)).otherwise(cut)
    return each.select("line_id", "chrom", "strand", start.alias("start_pos"), end.alias("end_pos")).where("start_pos < end_pos")


def regions(genes: DataFrame, kind: str) -> DataFrame:
    """``coding``, ``utr5``, ``utr3`` or ``transcribed`` stretch of every gene; empty ones are left out."""
    minus = F.col("strand") == "-"
    left, right = (F.col("chrom_start"), F.col("cds_start")), (F.col("cds_end"), F.col("chrom_end"))
    if kind == "coding":
        s, e = F.col("cds_start"), F.col("cds_end")
    elif kind == "transcribed":
        s, e = F.col("chrom_start"), F.col("chrom_end")
    elif kind in ("utr5", "utr3"):
        on_right = minus if kind == "utr5" else ~minus
        s, e = (F.when(on_right, right[i]).otherwise(left[i]) for i in (0, 1))
    else:
        raise ValueError(kind)
    return genes.select("line_id", "chrom", "strand", s.alias("start_pos"), e.alias("end_pos")).where("start_pos < end_pos")


# The standard genetic code, codons in the order of the bases T C A G.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def genetic_code() -> dict[str, str]:
    bases = "TCAG"
    return {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate(bases) for j, b in enumerate(bases) for k, c in enumerate(bases)}


def degeneracy(codon: str, position: int) -> int:
    """How many bases at a codon's position give its amino acid (1, 2, 3 or 4)."""
    code = genetic_code()
    return sum(code[codon[:position] + b + codon[position + 1 :]] == code[codon] for b in "ACGT")


def codon_degeneracy(cds: DataFrame, key: str, text: str) -> DataFrame:
    """key, codon_no, codon, amino acid and the degeneracy of its three positions for coding texts.

    Codons with other letters than A, C, G, T are left out, and so is a rest of one or two bases.
    """
    table = F.create_map(*[x for c, a in genetic_code().items() for x in (F.lit(c), F.struct(F.lit(a).alias("aa"), *[F.lit(degeneracy(c, i)).alias(f"d{i + 1}") for i in range(3)]))])
    codons = F.regexp_extract_all(F.upper(text), F.lit("(?s)(...)"), F.lit(1))
    each = cds.where(F.length(text) >= 3).select(key, F.posexplode(codons).alias("codon_no", "codon"))
    return each.withColumn("_sl_t", F.try_element_at(table, F.col("codon"))).where("_sl_t is not null").select(key, "codon_no", "codon", "_sl_t.*")
