"""Interval queries over the peaks: set a is the peaks of tracks of assembly nar4, set b those of nar3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import ranges as R
from strandlake.operators.chunking import running_totals
from strandlake.plans.tables import table

_A = ["rec_id", "chrom", "start_pos", "end_pos", "strand"]


def peaks_of(spark: SparkSession, d: str, assembly: str) -> DataFrame:
    tracks = table(spark, d, "peak_track").where(F.col("assembly") == assembly).select("track_id")  # a fixed table of 48 rows
    return R.valid(table(spark, d, "narrow_peak").join(F.broadcast(tracks), "track_id")).select(*_A)


def _ab(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return peaks_of(spark, d, "nar4"), peaks_of(spark, d, "nar3")


def _all(spark: SparkSession, d: str) -> DataFrame:
    return R.valid(table(spark, d, "narrow_peak")).select(*_A)


def _lens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chrom_size")


Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = _BASE + sql
        return f

    return add


def _runs(name: str, src: str, dist: int = 0) -> str:
    return f""", {name}_0 as (select distinct chrom, start_pos s, end_pos e from {src}),
{name}_1 as (select *, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) m from {name}_0),
{name}_2 as (select *, sum(case when m is null or s > m + {dist} then 1 else 0 end) over (partition by chrom order by s, e rows unbounded preceding) g from {name}_1),
{name} as (select chrom, min(s) start_pos, max(e) end_pos from {name}_2 group by chrom, g)"""


_BASE = """with v as (select p.rec_id, p.chrom, p.start_pos, p.end_pos, p.strand, t.assembly from narrow_peak p left join peak_track t using (track_id)
  where p.chrom is not null and p.start_pos < p.end_pos),
a as (select * exclude (assembly) from v where assembly = 'nar4'), b as (select * exclude (assembly) from v where assembly = 'nar3'),
al as (select * exclude (assembly) from v)"""
_MA, _MB, _MALL = _runs("ma", "a"), _runs("mb", "b"), _runs("mall", "al")
_PAIR = "y.chrom = x.chrom and x.end_pos > y.start_pos and x.start_pos < y.end_pos"
_OV = "least(x.end_pos, y.end_pos) - greatest(x.start_pos, y.start_pos)"
_COV = f", cov as (select x.rec_id, sum({_OV}) c from a x join mb y on {_PAIR} group by x.rec_id)"
_BASES = f""", ix as (select x.chrom, greatest(x.start_pos, y.start_pos) start_pos, least(x.end_pos, y.end_pos) end_pos from ma x join mb y on {_PAIR})"""


def _minus(name: str, x: str, y: str) -> str:
    """Positions of the merged set x that aren't in the merged set y, by a sweep over the boundaries."""
    return f""", {name}_e as (select chrom, start_pos p, 1 dx, 0 dy from {x} union all select chrom, end_pos, -1, 0 from {x}
  union all select chrom, start_pos, 0, 1 from {y} union all select chrom, end_pos, 0, -1 from {y}),
{name}_g as (select chrom, p, sum(dx) dx, sum(dy) dy from {name}_e group by chrom, p),
{name}_r as (select chrom, p, sum(dx) over w nx, sum(dy) over w ny, lead(p) over (partition by chrom order by p) q from {name}_g
  window w as (partition by chrom order by p rows unbounded preceding)),
{name} as (select chrom, p start_pos, q end_pos from {name}_r where nx > 0 and ny = 0)"""


@query(_MALL + " select * from mall")
def merge_intervals(spark, d):
    return R.merge(_all(spark, d))


@query(_runs("near", "al", 200) + " select * from near")
def merge_within_200(spark, d):
    return R.merge(_all(spark, d), 200)


@query(_MALL + " select chrom, cast(sum(end_pos - start_pos) as bigint) bases from mall group by chrom")
def base_coverage(spark, d):
    return R.base_coverage(_all(spark, d))


@query(f" select x.*, y.start_pos b_start_pos, y.end_pos b_end_pos, y.rec_id b_rec_id, {_OV} overlap from a x join b y on {_PAIR}")
def overlap_join(spark, d):
    a, b = _ab(spark, d)
    return R.overlap_pairs(a, b, bring=["rec_id"])


@query(f" select x.rec_id, y.rec_id b_rec_id from a x join b y on {_PAIR} where {_OV} >= 50")
def overlap_mincols(spark, d):
    a, b = _ab(spark, d)
    return R.overlap_pairs(a, b, bring=["rec_id"], min_cols=50).select("rec_id", "b_rec_id")


@query(f" select x.rec_id, y.rec_id b_rec_id, x.start_pos, y.start_pos b_start_pos from a x full join b y on {_PAIR}")
def overlap_join_full_fill(spark, d):
    a, b = _ab(spark, d)
    out = R.overlap_join(a, b, "rec_id", "rec_id", keep_a=True, keep_b=True)
    return out.select("rec_id", "b_rec_id", "start_pos", "b_start_pos")


@query(_MB + _COV + " select a.* from a join cov using (rec_id)")
def overlap_semi(spark, d):
    a, b = _ab(spark, d)
    return R.semi(a, b, "rec_id")


@query(_MB + _COV + " select a.* from a anti join (select * from cov where c >= 100) k on k.rec_id = a.rec_id")
def overlap_anti(spark, d):
    a, b = _ab(spark, d)
    return R.semi(a, b, "rec_id", min_cols=100, reverse=True)


@query(_MB + _COV + " select a.*, case when c >= 100 then 1 else 0 end hit from a left join cov using (rec_id)")
def overlap_bool(spark, d):
    a, b = _ab(spark, d)
    return R.flag_overlap(a, b, "rec_id", min_cols=100)


@query(f" select count(*) n from b y where exists (select 1 from a x where {_PAIR})")
def count_intersections(spark, d):
    a, b = _ab(spark, d)
    return R.semi(b, a, "rec_id").agg(F.count("*").alias("n"))


@query(f", k as (select x.rec_id, count(*) n from a x join b y on {_PAIR} group by 1) select a.*, coalesce(n, 0) n_overlaps from a left join k using (rec_id)")
def count_overlaps(spark, d):
    a, b = _ab(spark, d)
    return R.count_overlaps(a, b, "rec_id")


@query(_MB + _COV + """ select a.*, coalesce(cast(c as bigint), 0) covered, coalesce(c, 0) / (end_pos - start_pos) fraction from a left join cov using (rec_id)""")
def coverage_fraction(spark, d):
    a, b = _ab(spark, d)
    return R.coverage(a, b, "rec_id")


@query(
    _MB + _runs("mm", "(select * from al where strand = '+')") + _minus("un", "mb", "mm")
    + f""", c1 as (select x.rec_id, sum({_OV}) c from a x join un y on {_PAIR} group by 1), c2 as (select x.rec_id, sum({_OV}) m from a x join mm y on {_PAIR} group by 1),
    j as (select a.*, coalesce(cast(c as bigint), 0) covered, coalesce(cast(m as bigint), 0) masked from a left join c1 using (rec_id) left join c2 using (rec_id))
    select *, case when end_pos - start_pos - masked > 0 then covered / (end_pos - start_pos - masked) else 0.0 end fraction from j"""
)
def coverage_masked(spark, d):
    a, b = _ab(spark, d)
    return R.masked_coverage(a, b, _all(spark, d).where("strand = '+'"), "rec_id")


@query(_MA + _MB + _BASES + " select * from ix")
def base_intersect(spark, d):
    a, b = _ab(spark, d)
    return R.base_intersect(R.merge(a), R.merge(b))


@query(_runs("u", "(select * from a union all select * from b)") + " select * from u")
def base_union(spark, d):
    return R.base_union(*_ab(spark, d))


@query(_MA + _MB + _minus("m", "ma", "mb") + " select * from m")
def base_difference(spark, d):
    a, b = _ab(spark, d)
    return R.base_subtract(R.merge(a), R.merge(b))


@query(
    _MA + _MB + _minus("m1", "ma", "mb") + _minus("m2", "mb", "ma") + _runs("xo", "(select * from m1 union all select * from m2)") + " select * from xo"
)
def base_xor(spark, d):
    return R.base_xor(*_ab(spark, d))


_LENS = ", ln as (select name chrom, 0 start_pos, max(length) end_pos from chrom_size where name is not null and length > 0 group by name)"


@query(_MALL + _LENS + ", lp as (select * from ln where chrom in (select chrom from mall))" + _minus("m", "lp", "mall") + " select * from m")
def complement_present(spark, d):
    return R.complement(_all(spark, d), _lens(spark, d))


@query(_MALL + _LENS + _minus("m", "ln", "mall") + " select * from m")
def complement_all(spark, d):
    return R.complement(_all(spark, d), _lens(spark, d), all_chroms=True)


@query(
    _MA + _MB + _BASES
    + """ select cast(coalesce((select sum(end_pos - start_pos) from ix), 0) as bigint) in_both,
    cast(coalesce((select sum(end_pos - start_pos) from ma), 0) - coalesce((select sum(end_pos - start_pos) from ix), 0) as bigint) only_first,
    cast(coalesce((select sum(end_pos - start_pos) from mb), 0) - coalesce((select sum(end_pos - start_pos) from ix), 0) as bigint) only_second"""
)
def basewise_summary(spark, d):
    return R.basewise_summary(*_ab(spark, d))


@query(_MB + f" select x.rec_id, x.chrom, greatest(x.start_pos, y.start_pos) start_pos, least(x.end_pos, y.end_pos) end_pos, x.strand from a x join mb y on {_PAIR}")
def intersect_pieces(spark, d):
    a, b = _ab(spark, d)
    return R.intersect(a, [b], "rec_id")


@query(_MB + _COV + " select a.* from a join cov using (rec_id) where c >= 20")
def intersect_whole(spark, d):
    a, b = _ab(spark, d)
    return R.intersect(a, [b], "rec_id", pieces=False, min_cols=20)


@query(
    _MB + _COV
    + f""", h as (select a.* from a join cov using (rec_id)), pts as (select rec_id, start_pos p from h union all select rec_id, end_pos from h
    union select x.rec_id, greatest(x.start_pos, y.start_pos) from h x join mb y on {_PAIR} union select x.rec_id, least(x.end_pos, y.end_pos) from h x join mb y on {_PAIR}),
    seg as (select rec_id, p s, lead(p) over (partition by rec_id order by p) e from (select distinct * from pts)),
    free as (select a.rec_id, a.chrom, seg.s start_pos, seg.e end_pos, a.strand from seg join a using (rec_id) where seg.e is not null
      and not exists (select 1 from mb y where y.chrom = a.chrom and y.start_pos < seg.e and y.end_pos > seg.s))
    select * from a anti join cov using (rec_id) union all select * from free"""
)
def subtract_pieces(spark, d):
    a, b = _ab(spark, d)
    return R.subtract(a, [b], "rec_id")


@query(_MB + _COV + " select a.* from a anti join (select * from cov where c >= 20) k on k.rec_id = a.rec_id")
def subtract_whole(spark, d):
    a, b = _ab(spark, d)
    return R.subtract(a, [b], "rec_id", pieces=False, min_cols=20)


def _near(before: str, n: int, dist: int) -> str:
    return f""", c as (select x.rec_id, y.rec_id near, y.start_pos s, y.end_pos e, case when {before} then 'before' else 'after' end side,
    case when {before} then x.start_pos - y.end_pos else y.start_pos - x.end_pos end distance from a x join b y on y.chrom = x.chrom
    and case when {before} then y.end_pos < x.start_pos and y.end_pos >= x.start_pos - {dist} else y.start_pos > x.end_pos and y.start_pos <= x.end_pos + {dist} end),
    k as (select *, row_number() over (partition by rec_id order by distance, s, e, near) "rank" from c)
    select rec_id, side, near, distance, cast("rank" as int) "rank" from k where "rank" <= {n}"""


_MINUS = "coalesce(x.strand in ('-', '-1'), false)"


@query(_near("true", 2, 2500))
def nearest_before(spark, d):
    return R.nearest(*_ab(spark, d), "rec_id", "rec_id", n=2)


@query(_near("false", 2, 2500))
def nearest_after(spark, d):
    return R.nearest(*_ab(spark, d), "rec_id", "rec_id", n=2, side="after")


@query(_near(f"not {_MINUS}", 1, 2500))
def upstream(spark, d):
    return R.stream_of(*_ab(spark, d), "rec_id", "rec_id")


@query(_near(_MINUS, 1, 2500))
def downstream(spark, d):
    return R.stream_of(*_ab(spark, d), "rec_id", "rec_id", up=False)


@query(
    _runs("r", "al", 100) + f""", m as (select y.rec_id, x.chrom, x.start_pos cluster_start, x.end_pos cluster_end from r x join al y on {_PAIR})
    select chrom, cluster_start, cluster_end, count(*) n_members from m group by all having count(*) >= 3"""
)
def clusters(spark, d):
    return R.clusters(_all(spark, d), "rec_id", max_dist=100, min_members=3)


@query(_runs("r", "al", 100) + f" select y.rec_id, x.chrom, x.start_pos cluster_start, x.end_pos cluster_end from r x join al y on {_PAIR}")
def cluster_members(spark, d):
    return R.cluster_members(_all(spark, d), "rec_id", max_dist=100)


@query(""", j as (select al.*, length from al left join (select name, max(length) length from chrom_size where name is not null group by name) l on l.name = al.chrom)
    select rec_id, chrom, case when end_pos - start_pos < 500 and coalesce(strand = '-', false) then greatest(end_pos - 500, 0) else start_pos end start_pos,
    case when end_pos - start_pos < 500 and not coalesce(strand = '-', false) then least(start_pos + 500, coalesce(length, 4611686018427387904)) else end_pos end end_pos,
    strand from j""")
def extend_to(spark, d):
    return R.extend_to(_all(spark, d), 500, _lens(spark, d))


@query(""" select rec_id, chrom, greatest(start_pos - case when coalesce(strand = '-', false) then 30 else 100 end, 0) start_pos,
    end_pos + case when coalesce(strand = '-', false) then 100 else 30 end end_pos, strand from al""")
def pad_strand(spark, d):
    return R.pad(_all(spark, d), 100, 30)


@query(
    _MALL + _LENS + ", lp as (select * from ln where chrom in (select chrom from mall))" + _minus("m", "lp", "mall")
    + """, c as (select *, (end_pos - start_pos) // 5000000 n from m), k as (select *, (end_pos - start_pos - n * 5000000) // (n + 1) skip from c where n > 0)
    select chrom, start_pos + (i + 1) * skip + i * 5000000 w_start, start_pos + (i + 1) * skip + i * 5000000 + 5000000 w_end from k, unnest(range(n)) t(i)"""
)
def build_windows(spark, d):
    return R.windows_in_gaps(_all(spark, d), 5_000_000, _lens(spark, d))


@query(" select chrom, start_pos, end_pos, strand from a union all select chrom, start_pos, end_pos, '.' from b")
def concat_intervals(spark, d):
    a, b = _ab(spark, d)
    return R.concat(a.select("chrom", "start_pos", "end_pos", "strand"), b.select("end_pos", "rec_id", "start_pos", "chrom"))


@query(
    """, o as (select *, sum(case when coalesce(strand = '-', false) then 1 else 0 end) over (partition by chrom order by start_pos, rec_id rows unbounded preceding) k from al),
    f as (select chrom || '|' || k chrom, start_pos, end_pos from o where not coalesce(strand = '-', false))""" + _runs("r", "f", 100)
    + " select string_split(chrom, '|')[1] chrom, start_pos, end_pos from r where end_pos - start_pos >= 100"
)
def covered_ranges(spark, d):
    flagged = _all(spark, d).withColumn("fine", ~F.coalesce(F.col("strand") == "-", F.lit(False)))
    return R.covered_ranges(flagged, ["rec_id"], "fine")


@query(""" select rec_id, chrom, row_number() over w row_no, cast(sum(end_pos - start_pos) over (w rows unbounded preceding) as bigint) run_width from al
    window w as (partition by chrom order by start_pos, rec_id)""")
def running_width(spark, d):
    rows = _all(spark, d).select("rec_id", "chrom", "start_pos", (F.col("end_pos") - F.col("start_pos")).alias("width"))
    return running_totals(rows, ["chrom"], ["start_pos", "rec_id"], ["width"]).select("rec_id", "chrom", "row_no", "run_width")


QUERIES = Q
