"""Per-species summaries of alignment blocks, divergence counts, tiling, chains from cigars."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import probability as P
from strandlake.functions import sequence as S
from strandlake.operators import alignment as L
from strandlake.operators import ranges as R
from strandlake.session import stage
from strandlake.sources.blocks import cigar_matches

CHROM, START, END = R.CHROM, R.START, R.END


def reference_spans(components: DataFrame) -> DataFrame:
    """block_id, chrom (the reference's source), start and end on its forward strand, score where there is one."""
    fine = components.where("comp_no = 0 and src is not null and start_pos is not null and aln_size > 0 and length(text) > 0")
    one = fine.groupBy(L.BLOCK).agg(F.min(F.struct("comp_id", "src", "start_pos", "aln_size", "strand", "src_size")).alias("r"))
    args = [F.col("r")[c] for c in ("start_pos", "aln_size", "strand", "src_size")]
    return one.select(L.BLOCK, F.col("r.src").alias(CHROM), S.forward_start(*args).alias(START), S.forward_end(*args).alias(END)).where(F.col(START) < F.col(END))


def region_coverage(components: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """key, species, fraction of the region that lies in blocks with the species."""
    here = components.where("length(text) > 0 and src is not null").select(L.BLOCK, S.src_species(F.col("src")).alias("species")).distinct()
    spans = reference_spans(components).join(here, L.BLOCK)
    # Overlapping blocks of a species count once.
    keyed = spans.select(F.concat_ws("\t", CHROM, "species").alias(CHROM), START, END)
    runs = R.merge(keyed).select(F.substring_index(CHROM, "\t", 1).alias(CHROM), F.substring_index(CHROM, "\t", -1).alias("species"), START, END)
    pairs = R.overlap_pairs(regions.select(key, CHROM, START, END), runs, bring=["species"])
    return pairs.groupBy(key, F.col("b_species").alias("species")).agg((F.sum("overlap") / F.max(F.col(END) - F.col(START))).alias("fraction"))


def alignability(regions: DataFrame, aligned: DataFrame, missing: DataFrame, key: str, species: Sequence[str]) -> DataFrame:
    """key, species, fraction aligned; null where too much is missing: over half of a region below 100 bases, over 50 bases of a longer one.

    aligned and missing are rows of (species, chrom, start_pos, end_pos).
    """
    each = regions.select(key, CHROM, START, END, F.explode(F.array(*[F.lit(s) for s in species])).alias("species"))
    cut = each.select(F.struct(key, "species").alias("_sl_k"), F.concat_ws("\t", CHROM, "species").alias(CHROM), START, END)
    keyed = lambda d: R.merge(d.select(F.concat_ws("\t", CHROM, "species").alias(CHROM), START, END))
    cov = cut.join(R.covered_of(cut, keyed(aligned), "_sl_k"), "_sl_k", "left")
    both = cov.join(R.covered_of(cut, keyed(missing), "_sl_k").withColumnRenamed("covered", "gone"), "_sl_k", "left")
    n, gone = F.col(END) - F.col(START), F.coalesce("gone", F.lit(0))
    bad = F.when(n < 100, gone > n * 0.5).otherwise(gone > 50)
    return both.select(f"_sl_k.{key}", "_sl_k.species", F.when(~bad & (n > 0), F.coalesce("covered", F.lit(0)) / n).alias("fraction"))


def species_in_all(files: DataFrame, file: str = "file", src: str = "src") -> DataFrame:
    """Species that occur in every file."""
    n = files.agg(F.countDistinct(file).alias("n_files"))  # one row
    per = files.where(F.col(src).isNotNull()).groupBy(S.src_species(F.col(src)).alias("species")).agg(F.countDistinct(file).alias("k"))
    return per.join(F.broadcast(n), F.col("k") == F.col("n_files")).select("species")


def divergence_table(windows: DataFrame, snps: DataFrame, divergent: DataFrame, neutral: DataFrame, key: str) -> DataFrame:
    """Per window: polymorphic and divergent sites, the same within neutral stretches, Fisher's and chi-square probability of the 2 x 2 table."""
    free = stage(R.merge(neutral), "neutral").df
    out = windows.select(key)
    for name, sites in (("snp", R.merge(snps)), ("div", R.merge(divergent))):
        sites = stage(sites, name).df
        for kind, s in ((name, sites), (f"ar_{name}", R.base_intersect(sites, free))):
            n = R.covered_of(windows, s, key).withColumnRenamed("covered", kind)
            out = out.join(n, key, "left").withColumn(kind, F.coalesce(kind, F.lit(0)))
    a, b, c, d = (F.col(x).cast("double") for x in ("snp", "div", "ar_snp", "ar_div"))
    n = a + b + c + d
    chi2 = n * (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) * (a + c) * (b + d))
    fine = ((a + b) * (c + d) * (a + c) * (b + d)) > 0
    return out.withColumn("fisher_p", P.fisher_p("snp", "div", "ar_snp", "ar_div")).withColumn("chi2_p", P.chi2_p(F.when(fine, chi2), F.lit(1.0)))


def counts_with_zeros(df: DataFrame, index: str, n: int) -> DataFrame:
    """idx, n for 0 .. n - 1, zeros included."""
    seen = df.groupBy(F.col(index).cast("bigint").alias("idx")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(n).select(F.col("id").alias("idx")).join(seen, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).alias("n"))


def covered_regions(components: DataFrame) -> DataFrame:
    """comp_id, src, reference span and identity of every component with any column like the reference."""
    pairs = L.pair_identity(L.pairs_with_first(components)).where("identity > 0").select(L.BLOCK, "comp_id", "src", "identity")
    return pairs.join(reference_spans(components), L.BLOCK).select("comp_id", "src", CHROM, START, END, "identity")


def divergent_sites(components: DataFrame) -> DataFrame:
    """species, chrom, start, end: runs of reference positions at which a species has another base."""
    ref = components.where("comp_no = 0 and strand = '+' and src is not null and start_pos is not null").groupBy(L.BLOCK).agg(F.min(F.struct("comp_id", "src", "start_pos"))["src"].alias(CHROM), F.min(F.struct("comp_id", "src", "start_pos"))["start_pos"].alias("_sl_s"))
    pairs = L.pairs_with_first(components).where("src is not null").join(ref, L.BLOCK)
    chars = F.zip_with(S.chars(F.upper("text0")), S.chars(F.upper("text1")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # Without the columns in which the reference has a gap, a column's place is its base's rank.
    based = F.filter(chars, lambda c: c["a"] != "-")
    each = pairs.select(S.src_species(F.col("src")).alias("species"), CHROM, "_sl_s", F.posexplode(based).alias("p", "c"))
    differ = F.col("c.a").isin(*"ACGT") & F.col("c.b").isin(*"ACGT") & (F.col("c.a") != F.col("c.b"))
    sites = each.where(differ).select(
        F.concat_ws("\t", CHROM, "species").alias(CHROM), (F.col("_sl_s") + F.col("p")).alias(START), (F.col("_sl_s") + F.col("p") + 1).alias(END)
    )
    runs = R.merge(sites)
    return runs.select(F.substring_index(CHROM, "\t", -1).alias("species"), F.substring_index(CHROM, "\t", 1).alias(CHROM), START, END)


def tile_plan(regions: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """key, start, end, block_id: each region cut where the best block changes; block_id is null where there is none.

    blocks are rows of (block_id, chrom, start_pos, end_pos, score). The highest score wins; among equal
    ones the larger block_id.
    """
    pairs = stage(R.overlap_pairs(regions.select(key, CHROM, START, END), blocks, bring=["block_id", "score"]), "tiles").df
    low, high = F.greatest(START, f"b_{START}").alias("s"), F.least(END, f"b_{END}").alias("e")
    pieces = pairs.select(key, low, high, F.col("b_block_id").alias("block_id"), F.col("b_score").alias("score"))
    marks = (
        regions.where(F.col(START) < F.col(END)).select(key, F.explode(F.array(START, END)).alias("p"))
        .unionByName(pieces.select(key, F.explode(F.array("s", "e")).alias("p"))).distinct()
    )
    along = Window.partitionBy(key).orderBy("p")
    cells = marks.select(key, F.col("p").alias("c_s"), F.lead("p").over(along).alias("c_e")).where("c_e is not null")
    # Cells and pieces of a region meet by the same binned join as intervals do.
    on = R.overlap_pairs(
        cells.select(F.col(key).cast("string").alias(CHROM), F.col("c_s").alias(START), F.col("c_e").alias(END)),
        pieces.select(F.col(key).cast("string").alias(CHROM), F.col("s").alias(START), F.col("e").alias(END), "block_id", "score"),
        bring=["block_id", "score"],
    )
    best = on.groupBy(F.col(CHROM).alias("_sl_k"), F.col(START).alias("c_s")).agg(F.max(F.struct(F.coalesce("b_score", F.lit(float("-inf"))).alias("s"), F.col("b_block_id").alias("b")))["b"].alias("block_id"))
    tiled = cells.withColumn("_sl_k", F.col(key).cast("string")).join(best, ["_sl_k", "c_s"], "left")
    changed = tiled.withColumn("new", F.coalesce((~F.col("block_id").eqNullSafe(F.lag("block_id").over(Window.partitionBy(key).orderBy("c_s")))).cast("int"), F.lit(1)))
    first = F.row_number().over(Window.partitionBy(key).orderBy("c_s")) == 1
    runs = changed.withColumn("run", F.sum(F.when(first, 1).otherwise(F.col("new"))).over(Window.partitionBy(key).orderBy("c_s").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run", "block_id").agg(F.min("c_s").alias(START), F.max("c_e").alias(END)).select(key, START, END, "block_id")


def tile_texts(regions: DataFrame, components: DataFrame, key: str, species: Sequence[str], scores: DataFrame, *, fill: str = "*") -> DataFrame:
    """key, species, text: every region tiled by its best blocks; the fill character where there is no block, gaps where a block lacks the species."""
    spans = reference_spans(components.where("strand = '+'")).join(scores, L.BLOCK, "left")
    plan = stage(tile_plan(regions, spans, key).withColumn("_sl_id", F.monotonically_increasing_id()), "plan").df
    cut = L.slice_by_reference(components, plan.where("block_id is not null").select(L.BLOCK, F.col(START).alias("ref_start"), F.col(END).alias("ref_end")))
    part = cut.withColumn("species", S.src_species(F.col("src"))).where("text is not null")
    one = part.groupBy(L.BLOCK, "ref_start", "ref_end", "species").agg(F.min(F.struct(L.NO, "comp_id", "text"))["text"].alias("text"))
    width = part.groupBy(L.BLOCK, "ref_start", "ref_end").agg(F.max(F.length("text")).alias("w"))
    grid = plan.select(key, START, END, L.BLOCK, F.explode(F.array(*[F.lit(s) for s in species])).alias("species"))
    named = {"ref_start": START, "ref_end": END}
    full = grid.join(width.withColumnsRenamed(named), [L.BLOCK, START, END], "left").join(one.withColumnsRenamed(named), [L.BLOCK, START, END, "species"], "left")
    cell = F.coalesce("text", F.repeat(F.lit("-"), F.col("w")), F.repeat(F.lit(fill), (F.col(END) - F.col(START)).cast("int")))
    rows = full.groupBy(key, "species").agg(F.sort_array(F.collect_list(F.struct(START, cell.alias("t")))).alias("p"))
    return rows.select(key, "species", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))


def chain_blocks_of_cigars(items: DataFrame, target: str, query: str, sizes: DataFrame) -> DataFrame:
    """Chain blocks (as ``liftover`` takes them) of every pair of a target and a query row of one gabid.

    items are rows of (species, gabid, chrom, start_pos, end_pos, strand, cigar), 1-based closed; sizes are
    rows of (species, name, length). Columns in which both match are mapped; a target on ``-`` is turned.
    """
    m = items.withColumn("m", cigar_matches(F.col("cigar"), F.lit(0))).withColumn("total", F.col("end_pos") - F.col("start_pos") + 1)
    each = m.select("species", "gabid", "chrom", "strand", (F.col("start_pos") - 1).alias("z"), "total", "m", F.posexplode("m").alias("i", "b"))
    before = F.aggregate(F.slice("m", F.lit(1), F.col("i")), F.lit(0).cast("bigint"), lambda s, x: s + x["e"] - x["s"])
    flat = each.select("species", "gabid", "chrom", "strand", "z", "total", F.col("b.s").alias("s"), F.col("b.e").alias("e"), before.alias("k"))
    side = lambda sp, p: flat.where(F.col("species") == sp).select("gabid", *[F.col(c).alias(f"{p}_{c}") for c in ("chrom", "strand", "z", "total", "s", "e", "k")])
    pairs = side(target, "t").join(side(query, "q"), "gabid").where("t_s < q_e and q_s < t_e")
    low, n = F.greatest("t_s", "q_s"), F.least("t_e", "q_e") - F.greatest("t_s", "q_s")
    t_at, q_at = F.col("t_k") + low - F.col("t_s"), F.col("q_k") + low - F.col("q_s")
    forward = lambda p, at: F.when(F.col(f"{p}_strand") == "-", F.col(f"{p}_z") + F.col(f"{p}_total") - at - n).otherwise(F.col(f"{p}_z") + at)
    lens = sizes.where(F.col("species") == query).select(F.col("name").alias("q_chrom"), F.col("length").alias("q_size"))
    rows = pairs.select("gabid", "t_chrom", "q_chrom", (F.col("t_strand") == F.col("q_strand")).alias("same"), forward("t", t_at).alias("ts"), forward("q", q_at).alias("qs"), n.alias("n"), low.alias("col"))
    sized = rows.join(lens, "q_chrom")
    number = F.row_number().over(Window.partitionBy("gabid", "t_chrom", "q_chrom").orderBy("ts")) - 1
    return sized.select(
        F.concat_ws(":", "gabid", "t_chrom", "q_chrom").alias("chain_id"), F.lit(0).alias("score"), F.col("t_chrom").alias("t_name"), F.col("q_chrom").alias("q_name"),
        F.when(F.col("same"), "+").otherwise("-").alias("q_strand"), "q_size", number.alias("block_no"), F.col("ts").alias("t_start"), (F.col("ts") + F.col("n")).alias("t_end"),
        F.when(F.col("same"), F.col("qs")).otherwise(F.col("q_size") - F.col("qs") - F.col("n")).alias("q_start"),
    )


def linear_model(df: DataFrame, y: str, xs: Sequence[str]) -> dict[str, float]:
    """Least-squares coefficients of y on the columns and ``intercept``, from one pass of sums (a table of as many rows as columns squared)."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    rows = df.where(F.col(y).isNotNull())
    for x in xs:
        rows = rows.where(F.col(x).isNotNull())
    k = len(cols)
    sums = [F.sum(a * b) for a in cols for b in cols] + [F.sum(a * F.col(y)) for a in cols]
    got = np.array([v or 0.0 for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).collect()[0]])
    beta = np.linalg.lstsq(got[: k * k].reshape(k, k), got[k * k :], rcond=None)[0]
    return dict(zip(["intercept", *xs], map(float, beta)))
