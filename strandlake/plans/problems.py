"""Queries of the general data-processing operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.chunking import key_totals
from strandlake.operators.periods import periods_and_gaps
from strandlake.plans.tables import table
from strandlake.session import stage
from strandlake.sources.gene_lines import failed_lines, gene_records

MAX_GAP = 1_000_000
MIN_SHARE_PERCENT = 5


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods_and_gaps(table(spark, sf_dir, "narrow_peak"))
    return found.where((F.col("kind") == "period") | (F.col("end_pos") - F.col("start_pos") <= MAX_GAP))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed_lines(table(spark, sf_dir, "gene_line")).select("line_id", "reason")


def p3_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    genes = gene_records(table(spark, sf_dir, "gene_line"))
    lists = {c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",") for c in ("block_sizes", "block_starts")}
    return genes.drop("file_name", "line_no", "raw_line", "loaded_at").withColumns(lists)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = table(spark, sf_dir, "narrow_peak").select(
        F.lit("narrow_peak").alias("tbl"), F.col("chrom").alias("key_value"), F.col("rec_id").alias("row_id"), "start_pos", "end_pos",
        (F.col("end_pos") - F.col("start_pos")).alias("width"),
    )
    components = table(spark, sf_dir, "maf_component").select(
        F.lit("maf_component").alias("tbl"), F.col("src").alias("key_value"), F.col("comp_id").alias("row_id"), "start_pos",
        (F.col("start_pos") + F.col("aln_size")).alias("end_pos"), F.col("aln_size").alias("width"),
    )
    return peaks.unionByName(components)


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_totals(
        _keyed(spark, sf_dir), ["tbl", "key_value"], sums=["width"], lows=["start_pos"], highs=["end_pos"], ends=["start_pos"], order="row_id"
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = stage(key_totals(_keyed(spark, sf_dir), ["tbl", "key_value"]), "totals").df
    whole = totals.groupBy("tbl").agg(F.sum("n_rows").alias("n_all"))  # two rows
    share = F.col("n_rows") * 100 >= F.col("n_all") * MIN_SHARE_PERCENT
    return totals.join(F.broadcast(whole), "tbl").where(F.col("key_value").isNotNull() & share).select("tbl", "key_value")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_genes, p6_found, p6_totals)}

_PERIODS = """
with v as (select distinct chrom, start_pos s, end_pos e from narrow_peak where chrom is not null and start_pos < end_pos),
w as (select *, max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) m from v),
x as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by chrom order by s, e rows unbounded preceding) g from w),
p as (select chrom, g, min(s) a, max(e) b from x group by chrom, g),
q as (select *, lead(a) over (partition by chrom order by a) nxt from p)
"""
# A line's fields, quotes kept: (text before a tab or the end), one quoted field may hold tabs.
_F = '("[^"]*(""[^"]*)*"|[^"\\t][^\\t]*|)'
_INT = "^-?[0-9]+$"
_GENES = f"""
with l as (select line_id, regexp_replace(raw_line, '\\r$', '') t from gene_line where raw_line is not null),
r as (select * from l where not regexp_matches(t, '^([ \\t]*$|#|track |browser )')),
q as (select *, regexp_full_match(t, '{_F}(\\t{_F})*') fine, list_transform(regexp_extract_all(chr(9) || t, '\\t{_F}', 1),
  lambda v: case when v[1] = '"' then replace(v[2:-2], '""', '"') else v end) f from r),
k as (select *, len(f) n, string_split(regexp_replace(f[11], ',$', ''), ',') zs, string_split(regexp_replace(f[12], ',$', ''), ',') ss from q),
i as (select *, fine and n = 12 and len(list_filter([f[2], f[3], f[5], f[7], f[8], f[10]] || zs || ss,
  lambda v: not regexp_matches(v, '{_INT}') or try_cast(v as bigint) is null)) = 0 whole from k),
c as (select *, try_cast(f[2] as bigint) a, try_cast(f[3] as bigint) b, try_cast(f[7] as bigint) ca, try_cast(f[8] as bigint) cb,
  try_cast(f[10] as bigint) bc from i),
o as (select *, case when not fine then 'quoting' when n <> 12 then 'columns' when not whole then 'integer'
  when f[6] not in ('+', '-', '.') then 'strand' when len(zs) <> bc or len(ss) <> bc then 'blocks'
  when not (0 <= a and a < b) or not (a <= ca and ca <= cb and cb <= b) then 'range'
  when len(list_filter(range(1, len(zs) + 1), lambda j: try_cast(zs[j] as bigint) < 1 or try_cast(ss[j] as bigint) < 0
    or try_cast(zs[j] as hugeint) + try_cast(ss[j] as hugeint) > b - a)) > 0 then 'range' end reason from c)
"""
_KEYED = """
with u as (select 'narrow_peak' tbl, chrom key_value, rec_id row_id, start_pos, end_pos, end_pos - start_pos width from narrow_peak
union all select 'maf_component', src, comp_id, start_pos, start_pos + aln_size, aln_size from maf_component)
"""
SQL = {
    "p2_found": f"""{_PERIODS} select 'period' kind, chrom, a start_pos, b end_pos from p
        union all select 'gap', chrom, b, nxt from q where nxt - b <= {MAX_GAP}""",
    "p3_found": f"{_GENES} select line_id, reason from o where reason is not null",
    "p3_genes": f"""{_GENES} select line_id, f[1] chrom, a chrom_start, b chrom_end, f[4] "name", cast(f[5] as bigint) score, f[6] strand,
        ca cds_start, cb cds_end, f[9] item_rgb, bc block_count,
        array_to_string(list_transform(zs, lambda v: cast(cast(v as bigint) as varchar)), ',') block_sizes,
        array_to_string(list_transform(ss, lambda v: cast(cast(v as bigint) as varchar)), ',') block_starts from o where reason is null""",
    "p6_found": f"""{_KEYED}, c as (select tbl, key_value, count(*) n, sum(count(*)) over (partition by tbl) n_all from u group by tbl, key_value)
        select tbl, key_value from c where key_value is not null and n * 100 >= n_all * {MIN_SHARE_PERCENT}""",
    "p6_totals": f"""{_KEYED} select tbl, key_value, count(*) n_rows, cast(sum(width) as bigint) sum_width, min(start_pos) min_start_pos,
        max(end_pos) max_end_pos, (min({{'o': row_id, 'v': start_pos}})).v first_start_pos,
        (max({{'o': row_id, 'v': start_pos}})).v last_start_pos from u group by tbl, key_value""",
}
