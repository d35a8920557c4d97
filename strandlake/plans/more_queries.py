"""Motifs, sampling and positional operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandlake.operators import motifs as M
from strandlake.operators import ranges as R
from strandlake.operators import sampling as O
from strandlake.operators import signal as S
from strandlake.plans import interval_queries
from strandlake.plans.interval_queries import peaks_of
from strandlake.plans.tables import table
from strandlake.session import stage

Q, SQL = {}, {}
COUNTS = np.array([[8, 0, 1, 1], [0, 9, 1, 0], [1, 0, 9, 0], [0, 1, 0, 9], [2, 2, 3, 3]], float)
THRESHOLD = 5.0


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _case(i: int) -> str:
    m = M.log_odds(COUNTS, correction=0.1)
    return f"case s[i + {i + 1}] " + " ".join(f"when '{c}' then cast({float(m[i, k])!r} as double)" for k, c in enumerate("ACGT")) + " end"


@query(f"""with t as (select comp_id, upper(text) s from maf_component where text is not null), w as (select comp_id, i col, {' + '.join(_case(i) for i in range(len(COUNTS)))} score
    from t, unnest(range(greatest(length(s) - {len(COUNTS) - 1}, 0))) u(i)) select comp_id, col, '+' strand, round(score, 6) score from w where score >= {THRESHOLD}""")
def motif_scan(spark, d):
    rows = table(spark, d, "maf_component")
    out = M.hits(rows, ["comp_id"], "text", M.log_odds(COUNTS, correction=0.1), THRESHOLD)
    return out.withColumn("score", F.round("score", 6))


@query("""with t as (select comp_id, upper(text) s from maf_component where length(text) >= 6) select comp_id, i - 1 col from t, unnest(range(1, length(s) - 4)) u(i)
    where regexp_matches(s[i:i + 5], '^T[AG]C[CT][AGT][ACGT]$')""")
def motif_exact_hits(spark, d):
    return M.exact_hits(table(spark, d, "maf_component"), ["comp_id"], "text", "TRCYDN")


@query("""with c as (select comp_no, upper(unnest(string_split(text, ''))) letter from maf_component where text is not null), n as (select comp_no, letter, count(*) n from c
    where letter in ('A', 'C', 'G', 'T') group by 1, 2), f as (select *, n / sum(n) over (partition by comp_no) f from n)
    select comp_no, letter, round(f * (2 + sum(f * log2(f)) over (partition by comp_no)), 8) height from f""")
def letter_heights(spark, d):
    chars = table(spark, d, "maf_component").select("comp_no", F.explode(F.split(F.upper("text"), "")).alias("letter")).where(F.col("letter").isin(*"ACGT"))
    n = chars.groupBy("comp_no", "letter").agg(F.count("*").alias("n"))
    return S.letter_heights(n, ["comp_no"], "letter", "n").withColumn("height", F.round("height", 8))


@query("with r as (select *, coalesce(sum(text_size) over (order by block_id rows between unbounded preceding and 1 preceding), 0) b from maf_block) select block_id, text_size from r where b < 20000")
def truncate_blocks(spark, d):
    return O.truncate(table(spark, d, "maf_block").select("block_id", "text_size"), ["block_id"], "text_size", 20_000)


@query("with r as (select *, coalesce(sum(text_size) over (order by block_id rows between unbounded preceding and 1 preceding), 0) b from maf_block) select block_id, cast(b // 5000 as bigint) chunk from r")
def chunk_blocks(spark, d):
    return O.chunk_numbers(table(spark, d, "maf_block").select("block_id", "text_size"), ["block_id"], "text_size", 5_000).select("block_id", "chunk")


@query("select event_id from (select event_id, row_number() over (order by ts, event_id) k from events) where (k - 1) % 10 = 0")
def strided(spark, d):
    return O.thin(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"], 10).select("event_id")


@query("""with a as (select block_id, row_number() over (order by added_at, block_id) k from maf_block), b as (select name, row_number() over (order by name) k from chrom_size)
    select block_id, name from a left join b using (k)""")
def abut_tables(spark, d):
    a = table(spark, d, "maf_block").select("block_id", "added_at")
    return O.abut(a, ["added_at", "block_id"], table(spark, d, "chrom_size").select("name"), ["name"]).select("block_id", "name")


@query("""with a as (select block_id, row_number() over (order by block_id) k from maf_block), b as (select case when n_components > 3 then '1' else '0' end f, row_number() over (order by block_id) k from maf_block)
    select block_id from a join b using (k) where f = '1'""")
def line_select(spark, d):
    blocks = table(spark, d, "maf_block")
    flags = blocks.select(F.col("block_id").alias("at"), F.when(F.col("n_components") > 3, "1").otherwise("0").alias("f"))
    return O.select_by_flags(blocks.select("block_id"), ["block_id"], flags, ["at"], "f")


@query("select least(count(*), 100) n, least(count(*), 100) n_apart, least(count(*), 100) n_there from events")
def random_sample(spark, d):
    """How many rows are drawn, how many differ and how many are the table's."""
    events = table(spark, d, "events").select("event_id")
    drawn = stage(O.sample_rows(events, ["event_id"], 100, seed=7), "drawn").df
    there = drawn.join(events, "event_id", "left_semi").agg(F.count("*").alias("n_there"))
    return drawn.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_apart")).join(there, F.lit(True))  # one row each


@query("select comp_id, length(text) n, array_to_string(list_sort(string_split(text, '')), '') letters from maf_component where length(text) > 0")
def shuffle_columns(spark, d):
    """Every text keeps its letters."""
    out = O.shuffle_columns(table(spark, d, "maf_component").where("length(text) > 0"), seed=7)
    return out.select("comp_id", F.length("text").alias("n"), F.array_join(F.array_sort(F.split("text", "")), "").alias("letters"))


@query("""with b as (select block_id, max(length(text)) w from maf_component where length(text) > 0 group by 1)
    select block_id, true size_ok, true inside_ok, true apart_ok, true whole_ok from b where w >= 100""")
def random_chop(spark, d):
    """Pieces of 50 columns lie inside their block, one after another, and leave less than two pieces of it out."""
    c = table(spark, d, "maf_component")
    width = c.where("length(text) > 0").groupBy("block_id").agg(F.max(F.length("text")).alias("w")).where("w >= 100")
    p = O.random_chop(c, 50, seed=7).join(width, "block_id").groupBy("block_id", "w")
    low, high = F.min("low"), F.max("high")
    return p.agg(
        F.bool_and(F.col("high") - F.col("low") == 50).alias("size_ok"), ((low >= 0) & (high <= F.col("w"))).alias("inside_ok"),
        (high - low == F.count_distinct("low") * 50).alias("apart_ok"), (F.col("w") - (high - low) < 100).alias("whole_ok"),
    ).select("block_id", "size_ok", "inside_ok", "apart_ok", "whole_ok")


def _spans(spark, d):
    rows = R.valid(table(spark, d, "narrow_peak"))
    return rows.groupBy("chrom").agg(F.lit(0).cast("bigint").alias("start_pos"), (F.max("end_pos") * 3).alias("end_pos"))


_SET_A = interval_queries._BASE + interval_queries._MA


@query(_SET_A + " select chrom, count(*) n, cast(sum(end_pos - start_pos) as bigint) bases, true inside, true apart from ma group by chrom")
def random_intervals(spark, d):
    """Every chrom's lengths are placed, within its span and without overlap."""
    spans = _spans(spark, d)
    thrown = stage(O.throw_random(R.merge(peaks_of(spark, d, "nar4")), spans, seed=7), "thrown").df
    apart = R.base_coverage(thrown).withColumnRenamed("bases", "covered")
    width = F.sum(F.col("end_pos") - F.col("start_pos"))
    placed = thrown.groupBy("chrom").agg(F.count("*").alias("n"), width.alias("bases"), F.min("start_pos").alias("lo"), F.max("end_pos").alias("hi"))
    both = placed.join(apart, "chrom").join(spans, "chrom")
    return both.select("chrom", "n", "bases", ((F.col("lo") >= F.col("start_pos")) & (F.col("hi") <= F.col("end_pos"))).alias("inside"), (F.col("covered") == F.col("bases")).alias("apart"))


@query(_SET_A + interval_queries._MB + interval_queries._BASES + " select cast(coalesce(sum(end_pos - start_pos), 0) as bigint) observed, true fine from ix")
def permutation_test(spark, d):
    out = O.overlap_test(peaks_of(spark, d, "nar4"), peaks_of(spark, d, "nar3"), _spans(spark, d), samples=10, seed=7)
    return out.select("observed", ((F.col("below") >= 0) & (F.col("below") <= 1) & (F.col("mean") >= 0) & (F.col("sd") >= 0)).alias("fine"))


QUERIES = Q
