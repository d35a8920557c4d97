"""Operators on alignment blocks: a block's components are rows of (block_id, comp_no, src, start_pos, aln_size, strand, src_size, text)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequence as S

BLOCK, NO = "block_id", "comp_no"


def nest(components: DataFrame) -> DataFrame:
    """One row a block: ``components`` in order of their number (ties by comp_id)."""
    names = [c for c in components.columns if c != BLOCK]
    first = [c for c in (NO, "comp_id") if c in names]
    item = F.struct(*first, *[c for c in names if c not in first])
    return components.groupBy(BLOCK).agg(F.sort_array(F.collect_list(item)).alias("components"))


def unnest(blocks: DataFrame) -> DataFrame:
    return blocks.select(BLOCK, F.inline("components"))


def limit_to_species(components: DataFrame, species: Sequence[str]) -> DataFrame:
    return components.where(S.src_species(F.col("src")).isin(list(species)))


def filter_blocks(components: DataFrame, *, n_components: int | None = None, min_columns: int = 0, where: str | None = None) -> DataFrame:
    """Components of blocks with that many components, that many columns, and for which an SQL expression
    over (n, text_size) holds."""
    size = components.groupBy(BLOCK).agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("text")), F.lit(0)).alias("text_size"))
    kept = size.where(F.col("text_size") >= min_columns)
    if n_components is not None:
        kept = kept.where(F.col("n") == n_components)
    if where:
        kept = kept.where(where)
    return components.join(kept.select(BLOCK), BLOCK, "left_semi")


def columns(components: DataFrame) -> DataFrame:
    """(block, component number, col, ch) of every character; components without text have none."""
    return components.select(BLOCK, NO, F.posexplode(S.chars(F.col("text"))).alias("col", "ch"))


def _texts(components: DataFrame) -> DataFrame:
    """``texts`` of each block in order of the components; missing and empty ones are left out."""
    item = F.struct(*[c for c in (NO, "comp_id") if c in components.columns], "text")
    return components.where("length(text) > 0").groupBy(BLOCK).agg(
        F.transform(F.sort_array(F.collect_list(item)), lambda t: t["text"]).alias("texts")
    )


def column_counts(components: DataFrame) -> DataFrame:
    """How often each composition of a column (its characters in order of the components) occurs."""
    glued = F.aggregate(
        "texts", F.array().cast("array<string>"),
        lambda so_far, t: F.zip_with(so_far, S.chars(t), lambda x, c: F.concat(F.coalesce(x, F.lit("")), F.coalesce(c, F.lit("")))),
    )
    return _texts(components).select(F.explode(glued).alias("column")).groupBy("column").agg(F.count("*").alias("n"))


def column_counts_all(components: DataFrame, alphabet: str, n_species: int) -> DataFrame:
    """As column_counts over blocks of n_species components, with zeros for the columns of the alphabet that don't occur."""
    spark = components.sparkSession
    seen = column_counts(filter_blocks(components, n_components=n_species))
    space = spark.range(len(alphabet) ** n_species)  # every composition once, a fixed number
    letters = [
        F.substring(F.lit(alphabet), (F.expr(f"id div {len(alphabet) ** i}") % len(alphabet) + 1).cast("int"), F.lit(1)) for i in range(n_species)
    ]
    every = space.select(F.concat(*letters).alias("column"))
    return every.join(seen, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("n"))


def ngram_counts(texts: DataFrame, text: str, n: int) -> DataFrame:
    """(word, n, frequency) of all windows of n characters."""
    letters = S.chars(F.col(text))
    word = letters
    for k in range(1, n):
        # A shorter array ends in nulls, and so do the words that would run over the end.
        word = F.zip_with(word, F.slice(letters, F.lit(k + 1), F.greatest(F.size(letters) - k, F.lit(0))), lambda a, b: F.concat(a, b))
    words = texts.where(F.length(text) >= n).select(F.explode(word).alias("word")).where("word is not null")
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.join(F.broadcast(total), how="cross").select("word", "n", (F.col("n") / F.col("total")).alias("frequency"))


def pairs_with_first(components: DataFrame) -> DataFrame:
    """Each component beside the block's component 0 of the same length: text0, text1 and their numbers."""
    rows = components.where("length(text) > 0")
    first = rows.where(F.col(NO) == 0).groupBy(BLOCK).agg(F.min(F.struct("comp_id", "text"))["text"].alias("text0"))
    other = rows.where(F.col(NO) > 0).select(BLOCK, NO, "comp_id", "src", F.col("text").alias("text1"))
    return other.join(first, BLOCK).where(F.length("text0") == F.length("text1"))


def _both(count: Column) -> Column:
    return F.coalesce(count, F.lit(0))


def pair_identity(pairs: DataFrame) -> DataFrame:
    """n_match, n_aligned (columns without a gap), identity, gap_fraction for pairs of texts, case ignored."""
    zipped = F.zip_with(S.chars(F.upper("text0")), S.chars(F.upper("text1")), lambda a, b: F.when((a != "-") & (b != "-"), (a == b).cast("int")))
    counted = pairs.withColumn("_sl_z", zipped)
    aligned = F.aggregate("_sl_z", F.lit(0), lambda s, v: s + F.when(v.isNotNull(), 1).otherwise(0))
    match = F.aggregate("_sl_z", F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))
    out = counted.withColumns({"n_match": match, "n_aligned": aligned}).drop("_sl_z")
    return out.withColumns(
        {
            "identity": F.when(F.col("n_aligned") > 0, F.col("n_match") / F.col("n_aligned")),
            "gap_fraction": 1 - F.col("n_aligned") / F.length("text0"),
        }
    )


def base_composition(components: DataFrame) -> DataFrame:
    """n_bases, n_gaps, gc_fraction, mean length of ungapped runs per component."""
    t = F.upper("text")
    gc = F.length("text") - F.length(F.translate(t, "GC", ""))
    acgt = F.length("text") - F.length(F.translate(t, "ACGT", ""))
    runs = F.regexp_count(F.col("text"), F.lit("[^-]+"))
    bases = F.length("text") - S.gap_count(F.col("text"))
    return components.where("length(text) > 0").select(
        BLOCK, NO, "comp_id", bases.cast("bigint").alias("n_bases"), S.gap_count(F.col("text")).cast("bigint").alias("n_gaps"),
        F.when(acgt > 0, gc / acgt).alias("gc_fraction"), F.when(runs > 0, bases / runs).alias("mean_run"),
    )


def column_at(text: Column, position: Column) -> Column:
    """Column (0-based) of the base with that 0-based rank; the text's length for the rank after the last."""
    at = F.filter(F.transform(S.chars(text), lambda c, i: F.when(c != "-", i)), lambda i: i.isNotNull())
    return F.coalesce(F.try_element_at(at, (position + 1).cast("int")), F.when(position == F.size(at), F.length(text)))


def slice_columns(components: DataFrame, low: Column, high: Column) -> DataFrame:
    """Components cut to columns [low, high) with their own start and size; missing texts stay missing."""
    begin, width = low.cast("int"), (high - low).cast("int")
    before, part = F.substring("text", F.lit(1), begin), F.substring("text", begin + 1, width)
    bases = lambda t: F.length(F.translate(t, "-", "")).cast("bigint")
    return components.withColumns(
        {"start_pos": F.when(F.col("text").isNotNull(), F.col("start_pos") + bases(before)).otherwise(F.col("start_pos")),
         "aln_size": F.when(F.col("text").isNotNull(), bases(part)).otherwise(F.lit(0)), "text": part}
    )


def slice_by_reference(components: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks cut to regions (block_id, ref_start, ref_end) on the reference component's own strand."""
    ref = components.where((F.col(NO) == 0) & F.col("text").isNotNull()).groupBy(BLOCK).agg(
        F.min(F.struct("comp_id", "start_pos", "text")).alias("r")
    )
    cut = ref.join(regions, BLOCK).select(
        BLOCK, "ref_start", "ref_end",
        column_at(F.col("r")["text"], F.greatest(F.col("ref_start") - F.col("r")["start_pos"], F.lit(0))).alias("_sl_lo"),
        column_at(F.col("r")["text"], F.least(F.col("ref_end") - F.col("r")["start_pos"], F.length(F.translate(F.col("r")["text"], "-", "")))).alias("_sl_hi"),
    )
    kept = cut.where(F.col("_sl_lo") < F.col("_sl_hi"))
    return slice_columns(components.join(kept, BLOCK), F.col("_sl_lo"), F.col("_sl_hi")).drop("_sl_lo", "_sl_hi")


def reverse_complement(components: DataFrame) -> DataFrame:
    """Every component on its other strand; its two neighbours' states change sides."""
    out = components.withColumns(
        {"start_pos": F.col("src_size") - F.col("start_pos") - F.col("aln_size"),
         "strand": F.when(F.col("strand") == "+", "-").when(F.col("strand") == "-", "+").otherwise(F.col("strand")),
         "text": S.reverse_complement(F.col("text"))}
    )
    if "left_status" not in components.columns:
        return out
    swap = {"left_status": "right_status", "right_status": "left_status", "left_len": "right_len", "right_len": "left_len"}
    return out.withColumns({k: F.col(v) for k, v in swap.items()})


def remove_gap_columns(components: DataFrame) -> DataFrame:
    """Takes out the columns in which every text of the block has a gap."""
    used = F.aggregate(
        "texts", F.array().cast("array<boolean>"),
        lambda so_far, t: F.zip_with(so_far, S.chars(t), lambda x, c: F.coalesce(x, F.lit(False)) | F.coalesce(c != "-", F.lit(False))),
    )
    joined = components.join(_texts(components).select(BLOCK, used.alias("_sl_used")), BLOCK, "left")
    kept = F.filter(F.zip_with(S.chars(F.col("text")), F.col("_sl_used"), lambda c, u: F.when(u, c)), lambda c: c.isNotNull())
    text = F.when(F.length("text") > 0, F.array_join(kept, "")).otherwise(F.col("text"))
    return joined.withColumn("text", text).drop("_sl_used")


def thread_species(components: DataFrame, species: Sequence[str]) -> DataFrame:
    """Blocks that hold all the species, cut to them, without columns of gaps only."""
    names = list(dict.fromkeys(species))
    named = components.withColumn("_sl_sp", S.src_species(F.col("src"))).where(F.col("_sl_sp").isin(names))
    whole = named.groupBy(BLOCK).agg(F.countDistinct("_sl_sp").alias("k")).where(F.col("k") == len(names)).select(BLOCK)
    return remove_gap_columns(named.join(whole, BLOCK, "left_semi").drop("_sl_sp"))


def fuse(components: DataFrame) -> DataFrame:
    """Joins neighbouring blocks of the same sources, strands and sizes whose components go on without a break.

    Blocks are in order of their reference component; a block with a missing or empty component joins none.
    """
    key = F.transform("components", lambda c: F.concat_ws("|", c["src"], c["strand"], c["src_size"].cast("string")))
    fine = F.forall("components", lambda c: (F.length(c["text"]) > 0) & c["src"].isNotNull() & c["strand"].isNotNull() & c["start_pos"].isNotNull() & c["aln_size"].isNotNull())
    blocks = nest(components).withColumns(
        {"fine": F.coalesce(fine, F.lit(False)), "key": F.array_join(key, ";"),
         "starts": F.transform("components", lambda c: c["start_pos"]), "ends": F.transform("components", lambda c: c["start_pos"] + c["aln_size"])}
    ).withColumn("key", F.when(F.col("fine"), F.col("key")).otherwise(F.concat(F.lit("#"), F.col(BLOCK).cast("string"))))
    # A block goes on with the block that starts where it ends; only such links are needed, not an order of all blocks.
    along = Window.partitionBy("key").orderBy(F.col("starts")[0], BLOCK)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    linked = blocks.withColumn("goes_on", F.coalesce(F.col("fine") & (F.lag("ends").over(along) == F.col("starts")), F.lit(False)))
    runs = linked.withColumn("run", F.sum((~F.col("goes_on")).cast("int")).over(upto))
    item = F.struct(F.col("starts")[0].alias("s"), BLOCK, "components")
    joined = runs.groupBy("key", "run").agg(F.sort_array(F.collect_list(item)).alias("b"))
    first = F.col("b")[0]
    texts = lambda i: F.array_join(F.transform("b", lambda x: x["components"][i]["text"]), "")
    sizes = lambda i: F.aggregate("b", F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x["components"][i]["aln_size"], F.lit(0)))
    return joined.select(
        first[BLOCK].alias(BLOCK), F.size("b").alias("n_blocks"), first["components"].alias("_sl_c"), F.col("b")
    ).select(BLOCK, "n_blocks", F.posexplode("_sl_c").alias("i", "c"), "b").select(
        BLOCK, "n_blocks", F.col("i").alias(NO), F.col("c")["src"].alias("src"), F.col("c")["start_pos"].alias("start_pos"),
        sizes(F.col("i")).alias("aln_size"), F.col("c")["strand"].alias("strand"), texts(F.col("i")).alias("text"),
    )


def pair_score(text0: Column, text1: Column, matrix: Mapping[tuple[str, str], int], gap_open: int, gap_extend: int) -> Column:
    """Score of two texts with affine gaps; columns of gaps only count nothing, letters are taken in upper case."""
    table = F.create_map(*[F.lit(x) for (a, b), s in matrix.items() for x in (a + b, int(s))])
    joined = F.zip_with(S.chars(F.upper(text0)), S.chars(F.upper(text1)), lambda a, b: F.concat(a, b))

    def step(state: Column, pair: Column) -> Column:
        g0, g1 = F.startswith(pair, F.lit("-")), F.endswith(pair, F.lit("-"))
        cost0 = F.when(state["g0"], gap_extend).otherwise(gap_open + gap_extend)
        cost1 = F.when(state["g1"], gap_extend).otherwise(gap_open + gap_extend)
        score = F.when(g0 & g1, 0).when(g0, -cost0).when(g1, -cost1).otherwise(F.coalesce(F.try_element_at(table, pair), F.lit(0)))
        return F.struct(
            (state["score"] + score).cast("bigint").alias("score"),
            F.when(g0 & g1, state["g0"]).otherwise(g0).alias("g0"),
            F.when(g0 & g1, state["g1"]).otherwise(g1).alias("g1"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("score"), F.lit(False).alias("g0"), F.lit(False).alias("g1"))
    return F.aggregate(joined, start, step, lambda s: s["score"])


def parse_scheme(text: str, gap_open: int | None = None, gap_extend: int | None = None) -> tuple[dict[tuple[str, str], int], int, int]:
    """Scores by pair of upper-case letters, gap opening and gap extension, from the text of a scoring scheme.

    A line of column letters, then rows of numbers, each with its letter before them or, without one, in
    the order of the columns. ``O = n`` and ``E = n`` give the gap costs, ``#`` begins a remark.
    """
    columns: list[str] = []
    scores: dict[tuple[str, str], int] = {}
    costs, n_rows = {"O": gap_open, "E": gap_extend}, 0
    for raw in text.splitlines():
        line = raw.split("#")[0].strip()
        if not line:
            continue
        if "=" in line:
            for part in line.replace(",", " ").replace(" =", "=").replace("= ", "=").split():
                name, _, value = part.partition("=")
                if costs.get(name.upper(), 0) is None:
                    costs[name.upper()] = int(value)
            continue
        cells = line.split()
        if not columns:
            columns = [c.upper() for c in cells]
            continue
        named = not cells[0].lstrip("-").isdigit()
        letter = cells[0].upper() if named else columns[n_rows]
        values = cells[1:] if named else cells
        if len(values) != len(columns):
            raise ValueError(f"a row of the scheme has {len(values)} scores for {len(columns)} letters")
        scores |= {(letter, c): int(v) for c, v in zip(columns, values)}
        n_rows += 1
    if not scores or None in costs.values():
        raise ValueError("the scheme lacks scores or gap costs")
    return scores, costs["O"], costs["E"]


def running_scores(
    df: DataFrame, keys: Sequence[str], text0: str, text1: str, matrix: Mapping[tuple[str, str], int], gap_open: int, gap_extend: int, *, skip_gaps: bool = False
) -> DataFrame:
    """keys and ``scores``: the score of the two texts up to each column, columns of gaps only adding nothing.

    With ``skip_gaps`` columns in which the first text has a gap have no entry. Null texts and texts of
    different lengths give null, empty ones an empty list. One pass over byte arrays for each row.
    """
    table = np.zeros((256, 256), "int64")
    for (a, b), s in matrix.items():
        table[ord(a), ord(b)] = int(s)

    def scores(a: str, b: str) -> np.ndarray:
        x, y = (np.frombuffer(t.upper().encode("latin-1", "replace"), "uint8") for t in (a, b))
        g0, g1 = x == 45, y == 45
        at = np.flatnonzero(~(g0 & g1))
        p0, p1 = g0[at], g1[at]
        opens0, opens1 = (p & ~np.append(False, p[:-1]) for p in (p0, p1))
        gap = np.where(p0, gap_extend + gap_open * opens0, gap_extend + gap_open * opens1)
        one = np.zeros(len(x), "int64")
        one[at] = np.where(p0 | p1, -gap, table[x[at], y[at]])
        total = np.cumsum(one)
        return total[~g0] if skip_gaps else total

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scores(a, b) if a is not None and b is not None and len(a) == len(b) else None for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, pa.list_(pa.int64()))], names=[*keys, "scores"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(F.col(text0).alias("_sl_0"), F.col(text1).alias("_sl_1"), *keys).mapInArrow(work, f"{kinds}, scores array<bigint>")


def mask_runs(flags: Column) -> Column:
    """Runs of equal values of an array, as array of (value, start, end), half-open.

    ``flags`` should be a column that is there, not an expression, which would be computed for every place.
    """
    n = F.size(flags)
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    starts = F.filter(at, lambda i: (n > 0) & ((i == 0) | ~F.get(flags, i).eqNullSafe(F.get(flags, i - 1))))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.when(n > 0, F.array(n)).otherwise(F.array().cast("array<int>")))
    return F.zip_with(starts, ends, lambda s, e: F.struct(F.get(flags, s).alias("value"), s.alias("start"), e.alias("end")))


def by_source(components: DataFrame, src: str, *, prefix: bool = False) -> DataFrame:
    """The first component of each block whose source has that name, or begins with it."""
    fits = F.startswith("src", F.lit(src)) if prefix else F.col("src") == src
    names = [c for c in components.columns if c != BLOCK]
    first = [c for c in (NO, "comp_id") if c in names]
    item = F.struct(*first, *[c for c in names if c not in first])
    return components.where(fits).groupBy(BLOCK).agg(F.min(item).alias("c")).select(*[F.col(BLOCK) if c == BLOCK else F.col("c")[c].alias(c) for c in components.columns])


def cpg_columns(text0: Column, text1: Column, kind: str = "inclusive") -> Column:
    """Boolean per column: it is part of a CpG in either (``inclusive``) or in both texts (``restricted``).

    Empty texts have no columns; the two letters of a site are in neighbouring columns.
    """
    a, b = S.chars(F.upper(text0)), S.chars(F.upper(text1))

    def site(x: Column) -> Column:
        edge, n = F.array(F.lit("")), F.greatest(F.size(x) - 1, F.lit(0))
        after, before = F.concat(F.slice(x, F.lit(2), n), edge), F.concat(edge, F.slice(x, F.lit(1), n))
        opens = F.zip_with(x, after, lambda c, d: (c == "C") & (d == "G"))
        closes = F.zip_with(x, before, lambda c, d: (c == "G") & (d == "C"))
        return F.zip_with(opens, closes, lambda p, q: p | q)

    join = (lambda p, q: p | q) if kind == "inclusive" else (lambda p, q: p & q)
    return F.zip_with(site(a), site(b), join)


def mask_columns(text: Column, flags: Column, mark: str = "#") -> Column:
    """Replaces the flagged columns' letters; gaps stay."""
    return F.array_join(F.zip_with(S.chars(text), flags, lambda c, f: F.when(f & (c != "-"), F.lit(mark)).otherwise(c)), "")


def mask_quality(text: Column, quality: Column, least: int, mark: str = "?") -> Column:
    """Replaces letters whose quality (array by column, null for unknown) is below ``least``; gaps stay."""
    return F.array_join(F.zip_with(S.chars(text), quality, lambda c, q: F.when((c != "-") & (q < least), F.lit(mark)).otherwise(c)), "")


def max_wildcards(components: DataFrame, *, min_good: int, max_wild: int, wild: str = "*") -> DataFrame:
    """Components of blocks with at least min_good columns that have at most max_wild wildcard characters."""
    per_col = columns(components).groupBy(BLOCK, "col").agg(F.sum((F.col("ch") == wild).cast("int")).alias("w"))
    good = per_col.groupBy(BLOCK).agg(F.sum((F.col("w") <= max_wild).cast("int")).alias("k")).where(F.col("k") >= min_good)
    return components.join(good.select(BLOCK), BLOCK, "left_semi")


def translate_fill(text: Column) -> Column:
    """Fill characters as gaps or wildcards: # = - for gap, * elsewhere."""
    return F.translate(text, "#=X@", "-***")


def concat_species(components: DataFrame, species: Sequence[str]) -> DataFrame:
    """(species, text): every block's text of the species in order of blocks, gaps where it has none."""
    width = components.groupBy(BLOCK).agg(F.max(F.length("text")).alias("w")).where("w > 0")
    named = components.withColumn("species", S.src_species(F.col("src"))).where(F.length("text") > 0)
    one = named.groupBy(BLOCK, "species").agg(F.min(F.struct(NO, "comp_id", "text"))["text"].alias("text"))
    grid = width.select(BLOCK, "w", F.explode(F.array(*[F.lit(s) for s in species])).alias("species"))
    return grid.join(one, [BLOCK, "species"], "left").select(
        "species", BLOCK, F.coalesce("text", F.repeat(F.lit("-"), F.col("w"))).alias("text")
    )
