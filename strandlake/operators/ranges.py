"""Joins and position-set algebra on half-open intervals.

Overlap is strict (a.end > b.start and a.start < b.end). The join key is (chrom, level, bin): an
interval lives on the level whose bins are as wide as itself or wider, where it meets at most two bins,
and is repeated on wider levels only if the other side has intervals there. So short intervals meet in
narrow bins, and one long interval costs two rows, not thousands. A pair is kept in one bin only.
Intervals with a null in their three columns are in no pair, and empty ones are points in no interval.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.chunking import PART, running_totals
from strandlake.operators.periods import periods_and_gaps
from strandlake.session import stage

CHROM, START, END = "chrom", "start_pos", "end_pos"
#: Bins of level k are 2^(_SHIFTS[k]) wide.
_SHIFTS = tuple(range(9, 63, 4))
_FAR = 2**40


def valid(df: DataFrame) -> DataFrame:
    """Intervals with all three columns and start < end."""
    return df.where(F.col(CHROM).isNotNull() & (F.col(START) < F.col(END)))


def _level() -> Column:
    out = F.lit(len(_SHIFTS) - 1)
    for k in range(len(_SHIFTS) - 2, -1, -1):
        out = F.when(F.col(END) - F.col(START) <= 2 ** _SHIFTS[k], F.lit(k)).otherwise(out)
    return out


def _shift(level: Column) -> Column:
    return level * 4 + _SHIFTS[0]


def _levels_of(a: DataFrame, b: DataFrame) -> tuple[list[int], list[int]]:
    """The levels on which either side has intervals, found in one job of at most 28 rows."""
    marked = [valid(d).select(F.lit(i).alias("i"), _level().alias("k")) for i, d in enumerate((a, b))]
    found = marked[0].unionByName(marked[1]).distinct().collect()
    return tuple(sorted(r["k"] for r in found if r["i"] == i) for i in (0, 1))


def _binned(df: DataFrame, other_levels: list[int]) -> DataFrame:
    own = df.withColumn("_sl_own", _level())
    wider = F.filter(F.array(*[F.lit(k) for k in other_levels]), lambda k: k > F.col("_sl_own"))
    on = own.withColumn("_sl_level", F.explode(F.concat(F.array("_sl_own"), wider)))
    shift = _shift(F.col("_sl_level"))
    first, last = F.call_function("shiftright", F.col(START), shift), F.call_function("shiftright", F.col(END) - 1, shift)
    return on.withColumn("_sl_bin", F.explode(F.when(first == last, F.array(first)).otherwise(F.sequence(first, last))))


def overlap_pairs(a: DataFrame, b: DataFrame, *, min_cols: int = 1, bring: Sequence[str] = (), mark: str = "b_") -> DataFrame:
    """Every overlapping pair once: a's columns, ``b_start_pos``, ``b_end_pos``, b's columns ``bring`` marked, ``overlap``."""
    bring = [c for c in dict.fromkeys([START, END, *bring]) if c != CHROM]
    left, right = valid(a), valid(b.select(CHROM, *bring))
    la, lb = _levels_of(left, right)
    x = _binned(left, lb)
    y = _binned(right, la).select(
        F.col(CHROM).alias("_sl_c"), F.col("_sl_level").alias("_sl_l"), F.col("_sl_bin").alias("_sl_b"), F.col("_sl_own").alias("_sl_o"),
        *[F.col(c).alias(mark + c) for c in bring],
    )
    low, high = F.greatest(F.col(START), F.col(mark + START)), F.least(F.col(END), F.col(mark + END))
    same_bin = (F.col(CHROM) == F.col("_sl_c")) & (F.col("_sl_level") == F.col("_sl_l")) & (F.col("_sl_bin") == F.col("_sl_b"))
    meet = (F.col(END) > F.col(mark + START)) & (F.col(START) < F.col(mark + END))
    once = (F.col("_sl_level") == F.greatest("_sl_own", "_sl_o")) & (F.call_function("shiftright", low, _shift(F.col("_sl_level"))) == F.col("_sl_bin"))
    pairs = x.join(y, same_bin & meet & once)
    if min_cols > 1:
        pairs = pairs.where(high - low >= min_cols)
    return pairs.select(*a.columns, *[mark + c for c in bring], (high - low).alias("overlap"))


def overlap_join(a: DataFrame, b: DataFrame, key_a: str, key_b: str, *, min_cols: int = 1, bring: Sequence[str] = (), keep_a: bool = False, keep_b: bool = False) -> DataFrame:
    """Overlap join on unique keys; unmatched rows of a side are kept, the other side's columns null."""
    cols = list(dict.fromkeys([*bring, key_b]))
    pairs = overlap_pairs(a, b, min_cols=min_cols, bring=cols)
    if not (keep_a or keep_b):
        return pairs
    pairs = stage(pairs, "pairs").df
    out = pairs
    if keep_a:
        out = out.unionByName(a.join(pairs.select(key_a).distinct(), key_a, "left_anti"), allowMissingColumns=True)
    if keep_b:
        lone = b.join(pairs.select(F.col(f"b_{key_b}").alias(key_b)).distinct(), key_b, "left_anti")
        named = list(dict.fromkeys([START, END, *cols]))
        out = out.unionByName(lone.select(CHROM, *[F.col(c).alias(f"b_{c}") for c in named if c != CHROM]), allowMissingColumns=True)
    return out


def merge(df: DataFrame, max_dist: int = 0) -> DataFrame:
    """Maximal covered runs; runs at most ``max_dist`` apart are joined (0: touching ones)."""
    rows = valid(df.select(CHROM, START, END))
    wide = rows.withColumn(END, F.col(END) + max_dist) if max_dist else rows
    runs = periods_and_gaps(wide).where("kind = 'period'").drop("kind")
    return runs.withColumn(END, F.col(END) - max_dist) if max_dist else runs


def base_coverage(df: DataFrame) -> DataFrame:
    """Bases covered by at least one interval, by chrom."""
    return merge(df).groupBy(CHROM).agg(F.sum(F.col(END) - F.col(START)).alias("bases"))


def covered_of(a: DataFrame, b_merged: DataFrame, key: str) -> DataFrame:
    """key, covered: bases of each overlapped row of a that the merged set covers."""
    return overlap_pairs(a.select(key, CHROM, START, END), b_merged).groupBy(key).agg(F.sum("overlap").alias("covered"))


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a with ``covered`` bases and their ``fraction`` (0 for empty intervals and where b has none)."""
    done = a.join(covered_of(a, merge(b), key), key, "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    width = F.col(END) - F.col(START)
    return done.withColumn("fraction", F.when(width > 0, F.col("covered") / width).otherwise(F.lit(0.0)))


def masked_coverage(a: DataFrame, b: DataFrame, mask: DataFrame, key: str) -> DataFrame:
    """As ``coverage``, with masked bases taken out of both numerator and denominator."""
    gone = merge(mask)
    left = stage(base_subtract(merge(b), gone), "unmasked").df
    both = a.join(covered_of(a, left, key), key, "left").join(
        covered_of(a, gone, key).withColumnRenamed("covered", "masked"), key, "left"
    )
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("covered", "masked")})
    open_bases = F.col(END) - F.col(START) - F.col("masked")
    return both.withColumn("fraction", F.when(open_bases > 0, F.col("covered") / open_bases).otherwise(F.lit(0.0)))


def semi(a: DataFrame, b: DataFrame, key: str, *, min_cols: int = 1, reverse: bool = False) -> DataFrame:
    """Rows of a of which b covers at least ``min_cols`` bases in total; the other rows if reversed."""
    hit = covered_of(a, merge(b), key).where(F.col("covered") >= min_cols).select(key)
    return a.join(hit, key, "left_anti" if reverse else "left_semi")


def flag_overlap(a: DataFrame, b: DataFrame, key: str, *, min_cols: int = 1) -> DataFrame:
    """a with ``hit`` 1 or 0."""
    hit = covered_of(a, merge(b), key).where(F.col("covered") >= min_cols).select(key, F.lit(1).alias("hit"))
    return a.join(hit, key, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def count_overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a with ``n_overlaps``, 0 where there are none.

    No pairs: the starts of b before an interval's end less the ends of b up to its start, from counts
    that run along the positions.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    no_key = F.lit(None).cast(a.schema[key].dataType)

    def rows(df: DataFrame, own, start_order: int, end_order: int, count) -> DataFrame:
        both = F.array(
            F.struct(own.alias("_sl_key"), F.col(START).alias("p"), F.lit(start_order).alias("o"), count.alias("s"), none.alias("e")),
            F.struct(own.alias("_sl_key"), F.col(END).alias("p"), F.lit(end_order).alias("o"), none.alias("s"), count.alias("e")),
        )
        return valid(df).select(CHROM, F.inline(both))

    # At one position: ends of b, then the intervals' starts (1) and ends (2), then starts of b.
    events = rows(b, no_key, 3, 0, one).groupBy(CHROM, "p", "o").agg(F.sum("s").alias("s"), F.sum("e").alias("e")).withColumn("_sl_key", no_key)
    asked = rows(a, F.col(key), 1, 2, none)
    run = running_totals(events.unionByName(asked), [CHROM], ["p", "o"], ["s", "e"]).where("o in (1, 2)")
    n = run.groupBy(F.col("_sl_key").alias(key)).agg(F.sum(F.when(F.col("o") == 2, F.col("run_s")).otherwise(-F.col("run_e"))).alias("n_overlaps"))
    return a.join(n, key, "left").withColumn("n_overlaps", F.coalesce("n_overlaps", F.lit(0)))


def _clip(pairs: DataFrame) -> DataFrame:
    low, high = F.greatest(START, f"b_{START}"), F.least(END, f"b_{END}")
    return pairs.withColumns({"_sl_s": low, "_sl_e": high}).drop(START, END, f"b_{START}", f"b_{END}", "overlap").withColumnsRenamed({"_sl_s": START, "_sl_e": END})


def intersect(a: DataFrame, others: Sequence[DataFrame], key: str, *, pieces: bool = True, min_cols: int = 1) -> DataFrame:
    """Parts of a's rows (or whole rows) that all other sets cover by at least ``min_cols`` bases.

    Pieces are the runs of the sets' intersection within a row, each at least ``min_cols`` long.
    """
    common = merge(others[0])
    for o in others[1:]:
        common = base_intersect(common, merge(o))
    if pieces:
        return _clip(overlap_pairs(a, common, min_cols=min_cols)).select(*a.columns)
    hit = covered_of(a, common, key).where(F.col("covered") >= min_cols).select(key)
    return a.join(hit, key, "left_semi")


def subtract(a: DataFrame, others: Sequence[DataFrame], key: str, *, pieces: bool = True, min_cols: int = 1) -> DataFrame:
    """a without what any other set covers.

    Rows covered by fewer than ``min_cols`` bases stay whole; of the others the uncovered parts come
    out, or nothing if ``pieces`` is false. The periods of the other sets and the gaps between them come
    from one pass, and one overlap join with both tells a row's covered bases and its uncovered parts.
    """
    union = others[0].select(CHROM, START, END)
    for o in others[1:]:
        union = union.unionByName(o.select(CHROM, START, END))
    rows = valid(a)
    if not pieces:
        hit = covered_of(rows, merge(union), key).where(F.col("covered") >= min_cols).select(key)
        return rows.join(hit, key, "left_anti")
    inner = stage(periods_and_gaps(union), "segments").df
    ends = inner.where("kind = 'period'").groupBy(CHROM).agg(F.min(START).alias("_sl_lo"), F.max(END).alias("_sl_hi"))
    # Before the first and after the last period everything is free.
    outer = ends.select(
        F.lit("gap").alias("kind"), CHROM,
        F.inline(F.array(F.struct(F.lit(-_FAR).alias(START), F.col("_sl_lo").alias(END)), F.struct(F.col("_sl_hi").alias(START), F.lit(_FAR).alias(END)))),
    )
    parts = stage(overlap_pairs(rows, inner.unionByName(outer), bring=["kind"]), "parts").df
    covered = parts.where("b_kind = 'period'").groupBy(key).agg(F.sum("overlap").alias("_sl_n"))
    hit = covered.where(F.col("_sl_n") >= min_cols).select(key)
    free = parts.where("b_kind = 'gap'").drop("b_kind").join(hit, key, "left_semi")
    return rows.join(hit, key, "left_anti").unionByName(_clip(free).select(*a.columns))


def _boundaries(state):
    """Pairs the starts and ends of runs along sorted events; those whose other side lies in another range come out alone."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits: tuple | None = None  # (part, chrom, start) of a run that has no end yet

        def row(chrom, start, end) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([chrom], pa.string()), pa.array([start], pa.int64()), pa.array([end], pa.int64())], names=[CHROM, START, END])

        for batch in batches:
            pos, na, nb, da, db = (batch.column(c).to_numpy() for c in ("p", "na", "nb", "da", "db"))
            now, was = state(na > 0, nb > 0), state(na - da > 0, nb - db > 0)
            at = np.flatnonzero(now != was)
            if not len(at):
                continue
            edges = batch.take(pa.array(at))
            chroms = edges.column(CHROM).dictionary_encode()
            code, part, opens, p = chroms.indices.to_numpy(), edges.column("part").to_numpy(), now[at], pos[at]
            if waits is not None:
                if waits[0] == part[0] and waits[1] == chroms.dictionary[int(code[0])].as_py() and not opens[0]:
                    yield row(waits[1], waits[2], int(p[0]))
                    code, part, opens, p = code[1:], part[1:], opens[1:], p[1:]
                else:
                    yield row(waits[1], waits[2], None)
                waits = None
                if not len(p):
                    continue
            # A start is closed by the next edge of the same chrom and range.
            paired = np.append(opens[:-1] & ~opens[1:] & (code[1:] == code[:-1]) & (part[1:] == part[:-1]), False)
            taken = np.append(False, paired[:-1])
            lone = ~paired & ~taken
            if lone[-1] and opens[-1]:
                waits, lone[-1] = (int(part[-1]), chroms.dictionary[int(code[-1])].as_py(), int(p[-1])), False
            i, j = np.flatnonzero(paired), np.flatnonzero(lone)
            rows = np.concatenate([i, j])
            start, end = np.concatenate([p[i], p[j]]), np.concatenate([p[np.minimum(i + 1, len(p) - 1)], p[j]])
            no_start = np.concatenate([np.zeros(len(i), bool), ~opens[j]])
            no_end = np.concatenate([np.zeros(len(i), bool), opens[j]])
            yield pa.RecordBatch.from_arrays(
                [chroms.dictionary.take(pa.array(code[rows])), pa.array(start, mask=no_start), pa.array(end, mask=no_end)], names=[CHROM, START, END]
            )
        if waits is not None:
            yield row(waits[1], waits[2], None)

    return work


def _swept(a: DataFrame, b: DataFrame) -> DataFrame:
    """chrom, p, na, nb, da, db, part: how many rows of a and of b begin (less those that end) at p, and cover what follows it.

    One shuffle, of one row a boundary position; rows of a part are in order.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def edges(df: DataFrame, in_a: bool) -> DataFrame:
        up = lambda at, n: F.struct(F.col(at).alias("p"), (n if in_a else none).alias("da"), (none if in_a else n).alias("db"))
        return valid(df).select(CHROM, F.inline(F.array(up(START, one), up(END, -one))))

    events = edges(a, True).unionByName(edges(b, False)).groupBy(CHROM, "p").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    run = running_totals(events.withColumn("p", F.col("p").cast("bigint")), [CHROM], ["p"], ["da", "db"], part=True)
    return run.select(F.col(CHROM).cast("string").alias(CHROM), "p", F.col("run_da").alias("na"), F.col("run_db").alias("nb"), "da", "db", F.col(PART).alias("part"))


def sweep(a: DataFrame, b: DataFrame, state) -> DataFrame:
    """Maximal runs of positions where ``state(in a, in b)`` (of boolean arrays) holds; it must not hold where neither set is.

    The sets need not be merged. One sweep over both sets' boundaries, cut into ranges; a run that
    crosses ranges is put together from its two ends.
    """
    found = stage(_swept(a, b).mapInArrow(_boundaries(state), f"{CHROM} string, {START} bigint, {END} bigint"), "runs").df
    whole = found.where(F.col(START).isNotNull() & F.col(END).isNotNull())
    halves = found.where(F.col(START).isNull() | F.col(END).isNull())  # at most two a chrom and range
    along = Window.partitionBy(CHROM).orderBy(F.coalesce(START, END))
    joined = halves.withColumn("_sl_end", F.lead(END).over(along)).where(F.col(START).isNotNull()).select(CHROM, START, F.col("_sl_end").alias(END))
    return whole.unionByName(joined)


def base_union(*sets: DataFrame) -> DataFrame:
    out = sets[0].select(CHROM, START, END)
    for s in sets[1:]:
        out = out.unionByName(s.select(CHROM, START, END))
    return merge(out)


def base_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions in both sets."""
    return sweep(a, b, lambda x, y: x & y)


def base_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions of the set a that aren't in the set b."""
    return sweep(a, b, lambda x, y: x & ~y)


def base_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return sweep(a, b, lambda x, y: x ^ y)


def complement(df: DataFrame, lengths: DataFrame, *, all_chroms: bool = False) -> DataFrame:
    """What the set leaves free of each chrom of (name, length); chroms without intervals if ``all_chroms``."""
    sizes = lengths.where("name is not null and length > 0").groupBy(F.col("name").alias(CHROM)).agg(F.max("length").alias("length"))
    whole = sizes.select(CHROM, F.lit(0).cast("bigint").alias(START), F.col("length").alias(END))
    if not all_chroms:
        whole = whole.join(valid(df).select(CHROM).distinct(), CHROM, "left_semi")
    return base_subtract(whole, df)


def basewise_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: bases in both, only in the first, only in the second set."""
    swept = stage(_swept(a, b), "swept").df
    # A boundary's bases reach to the next one: the weight of a position is minus its own for what begins there and plus for what ends.
    had = {"x": F.col("na") > 0, "y": F.col("nb") > 0, "wx": F.col("na") - F.col("da") > 0, "wy": F.col("nb") - F.col("db") > 0}
    bases = lambda now, was: F.coalesce(F.sum(F.when(was, F.col("p")).otherwise(0) - F.when(now, F.col("p")).otherwise(0)), F.lit(0))
    return swept.select("p", *[v.alias(k) for k, v in had.items()]).agg(
        bases(F.col("x") & F.col("y"), F.col("wx") & F.col("wy")).alias("in_both"),
        bases(F.col("x") & ~F.col("y"), F.col("wx") & ~F.col("wy")).alias("only_first"),
        bases(~F.col("x") & F.col("y"), ~F.col("wx") & F.col("wy")).alias("only_second"),
    )


def clusters(df: DataFrame, key: str, *, max_dist: int = 0, min_members: int = 1) -> DataFrame:
    """chrom, start, end, n_members of clusters of intervals at most ``max_dist`` apart."""
    found = cluster_members(df, key, max_dist=max_dist)
    return found.groupBy(CHROM, "cluster_start", "cluster_end").agg(F.count("*").alias("n_members")).where(F.col("n_members") >= min_members)


def cluster_members(df: DataFrame, key: str, *, max_dist: int = 0) -> DataFrame:
    """key, chrom and the bounds of the cluster each interval is in."""
    runs = stage(merge(df, max_dist), "clusters").df
    pairs = overlap_pairs(df.select(key, CHROM, START, END), runs)
    return pairs.select(key, CHROM, F.col(f"b_{START}").alias("cluster_start"), F.col(f"b_{END}").alias("cluster_end"))


def _near(a: DataFrame, b: DataFrame, key_a: str, key_b: str, n: int, max_dist: int, side: Column) -> DataFrame:
    """side: 'before', 'after' or null for each row of a.

    No pairs beyond the answer: along the sorted edges every interval of b has its number and every row
    of a the number of b's it has passed, so its neighbours are the last n numbers.
    """
    asked = a.where(F.col(CHROM).isNotNull() & F.col(START).isNotNull() & F.col(END).isNotNull()).withColumn("_sl_side", side)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    out = []
    for name in ("before", "after"):
        before = name == "before"
        queries = asked.where(F.col("_sl_side") == name).select(
            CHROM, F.col(START if before else END).cast("bigint").alias("p"), F.lit(0).alias("o"), none.alias("c"), F.col(key_a).alias("_sl_key")
        )
        points = valid(b).select(
            CHROM, F.col(END if before else START).cast("bigint").alias("p"), F.lit(1).alias("o"), one.alias("c"),
            F.col(key_b).alias("near"), F.col(START).alias("s"), F.col(END).alias("e"),
        )
        # The nearest comes last: of equal distance the one with the smallest start, end and key. Touching ones come after the row.
        order = [F.col("p") if before else F.col("p").desc(), "o", F.col("s").desc(), F.col("e").desc(), F.col("near").desc()]
        run = stage(running_totals(queries.unionByName(points, allowMissingColumns=True), [CHROM], order, ["c"]), "near").df
        numbered = run.where("o = 1").select(CHROM, F.col("run_c").alias("_sl_no"), "near", F.col("p").alias("b_p"))
        wanted = run.where("o = 0").select("_sl_key", CHROM, "p", "run_c", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("rank"))
        wanted = wanted.withColumn("_sl_no", F.col("run_c") - F.col("rank") + 1).where("_sl_no > 0")
        distance = F.col("p") - F.col("b_p") if before else F.col("b_p") - F.col("p")
        found = wanted.join(numbered, [CHROM, "_sl_no"]).withColumn("distance", distance).where(F.col("distance") <= max_dist)
        out.append(found.select(F.col("_sl_key").alias(key_a), F.lit(name).alias("side"), "near", "distance", "rank"))
    return out[0].unionByName(out[1])


def nearest(a: DataFrame, b: DataFrame, key_a: str, key_b: str, *, n: int = 1, max_dist: int = 2500, side: str = "before") -> DataFrame:
    """The n nearest intervals of b that lie wholly before or after each row of a, touching ones excluded.

    Ties go by start, end and key. The distance is from edge to edge, at most ``max_dist``.
    """
    return _near(a, b, key_a, key_b, n, max_dist, F.lit(side))


def stream_of(a: DataFrame, b: DataFrame, key_a: str, key_b: str, *, n: int = 1, max_dist: int = 2500, up: bool = True, strand: str = "strand") -> DataFrame:
    """The n nearest upstream (or downstream) intervals; on strand ``-`` or ``-1`` the sides are swapped."""
    minus = F.coalesce(F.col(strand).cast("string").isin("-", "-1"), F.lit(False))
    side = F.when(minus, "after" if up else "before").otherwise("before" if up else "after")
    return _near(a, b, key_a, key_b, n, max_dist, side)


def extend_to(df: DataFrame, n: int, lengths: DataFrame, strand: str = "strand") -> DataFrame:
    """Intervals shorter than n grow to n in the direction of their strand, within 0 and the chrom's length."""
    sizes = lengths.where("name is not null").groupBy(F.col("name").alias("_sl_name")).agg(F.max("length").alias("_sl_length"))
    short = F.col(END) - F.col(START) < n
    minus = F.coalesce(F.col(strand) == "-", F.lit(False))
    s = F.when(short & minus, F.greatest(F.col(END) - n, F.lit(0))).otherwise(F.col(START))
    e = F.when(short & ~minus, F.least(F.col(START) + n, F.coalesce("_sl_length", F.lit(2**62)))).otherwise(F.col(END))
    joined = df.join(sizes, F.col(CHROM) == F.col("_sl_name"), "left")
    return joined.withColumns({"_sl_s": s, "_sl_e": e}).withColumns({START: F.col("_sl_s"), END: F.col("_sl_e")}).select(*df.columns)


def pad(df: DataFrame, upstream: int, downstream: int, strand: str = "strand") -> DataFrame:
    """Grows intervals upstream and downstream (swapped on strand ``-``), not below 0."""
    minus = F.coalesce(F.col(strand) == "-", F.lit(False))
    s = F.greatest(F.col(START) - F.when(minus, downstream).otherwise(upstream), F.lit(0))
    return df.withColumns({START: s, END: F.col(END) + F.when(minus, upstream).otherwise(downstream)})


def windows_in_gaps(df: DataFrame, size: int, lengths: DataFrame) -> DataFrame:
    """Windows of a fixed size spread evenly over what the set leaves free of each chrom that it touches."""
    free = complement(df, lengths)
    count = F.expr(f"({END} - {START}) div {size}")
    with_count = free.withColumn("_sl_n", count).where("_sl_n > 0")
    skip = F.expr(f"({END} - {START} - _sl_n * {size}) div (_sl_n + 1)")
    each = with_count.withColumn("_sl_skip", skip).withColumn("_sl_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_sl_n") - 1)))
    start = F.col(START) + (F.col("_sl_i") + 1) * F.col("_sl_skip") + F.col("_sl_i") * size
    return each.select(CHROM, start.alias("w_start"), (start + size).alias("w_end"))


def concat(*sets: DataFrame, fill: str = ".") -> DataFrame:
    """Rows of all sets in the first one's layout; columns a set lacks are filled, others cut."""
    names = sets[0].columns
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s.select(*[F.col(c) if c in s.columns else F.lit(fill).alias(c) for c in names]))
    return out


def covered_ranges(df: DataFrame, order: Sequence[str], flag: str, *, span: int = 100, least: int = 100) -> DataFrame:
    """Sessions of rows in order of (chrom, start, ``order``) that lie at most ``span`` apart.

    A row with a false or null ``flag`` ends a session. Sessions of at least ``least`` bases come out.
    """
    rows = df.where(F.col(CHROM).isNotNull() & F.col(START).isNotNull() & F.col(END).isNotNull())
    marked = rows.withColumn("_sl_break", F.when(F.col(flag), 0).otherwise(1).cast("bigint"))
    epochs = running_totals(marked.select(CHROM, START, END, *order, "_sl_break"), [CHROM], [START, *order], ["_sl_break"])
    # Rows between two breaks are a sequence of their own.
    apart = epochs.where("_sl_break = 0").select(F.concat_ws("\t", CHROM, "run__sl_break").alias(CHROM), START, END)
    runs = merge(apart, span)
    return runs.where(F.col(END) - F.col(START) >= least).withColumn(CHROM, F.substring_index(CHROM, "\t", 1))
