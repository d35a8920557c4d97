"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.packing import CAPACITY, pack_documents
from strandlake.llm.radix import combine, digest, percentiles, percentiles_of
from strandlake.llm.reading import reading_levels
from strandlake.llm.splitting import split_components
from strandlake.llm.tokenizer import decoded_texts, token_ids
from strandlake.llm.topn import top_n
from strandlake.plans.tables import PEAK, table, usable
from strandlake.session import small_side, stage

TOP = 10
MIN_VALUES = 100


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks = table(spark, sf_dir, "narrow_peak").where(usable("signalvalue"))
    best = top_n(peaks, TOP, "chrom", "signalvalue", then=["score"], unique_id="rec_id", same=PEAK)
    return best.select("chrom", "rec_id")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, field, v: the usable measures of the peaks, copies once."""
    peaks = table(spark, sf_dir, "narrow_peak").where("chrom is not null").select(*PEAK).distinct()
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in ("signalvalue", "pvalue")])
    return peaks.select("chrom", F.inline(fields)).where(usable("v"))


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(_values(spark, sf_dir), ["chrom", "field"], "v", [50, 90, 99], MIN_VALUES)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = table(spark, sf_dir, "pct_bound")
    over = F.col("value") > F.col("bound")
    side = small_side(bounds, bounds.count())
    return p4_percentiles(spark, sf_dir).join(side, ["field", "pct"]).where(over).select("chrom", "field", "pct")


def p4_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from two loads digested apart and put together, and whether they keep the stated bound against the exact ones."""
    values = stage(_values(spark, sf_dir), "values").df
    early = F.coalesce(F.pmod(F.xxhash64("v"), F.lit(2)), F.lit(0)) == 0
    state = combine(*[digest(values.where(load), ["chrom", "field"], "v", 24) for load in (early, ~early)])
    near = percentiles_of(state, [50, 90, 99], 24).where(F.col("n") >= MIN_VALUES).withColumnRenamed("value", "near")
    exact = percentiles(values, ["chrom", "field"], "v", [50, 90, 99], MIN_VALUES)
    off = F.col("value") - F.col("near")
    kept = (off >= 0) & (off <= F.abs("value") * 2.0**-12)
    return near.join(exact.drop("n"), ["chrom", "field", "pct"]).select("chrom", "field", "pct", "n", kept.alias("kept"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_components(table(spark, sf_dir, "maf_component"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).groupBy("comp_id").agg(F.max(F.col("forced").cast("int")).alias("forced"))


def p5_pieces_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each divided component: whether its pieces keep the limit, the overlap, the whole text, their own start and size."""
    pieces = p5_pieces(spark, sf_dir).join(
        table(spark, sf_dir, "maf_component").select(F.col("comp_id"), "text", F.col("start_pos").alias("whole_start")), "comp_id"
    )
    own = lambda t: F.length(F.regexp_replace(t, "-", ""))
    begin = F.col("whole_start") + own(F.substring("text", F.lit(1), F.col("col_start").cast("int")))
    per = pieces.groupBy("comp_id").agg(
        F.max(F.length("piece_text")).alias("longest"),
        F.sort_array(F.collect_list(F.struct("piece_no", "col_start", "col_end"))).alias("x"),
        F.bool_and(F.col("piece_text") == F.substring("text", F.col("col_start").cast("int") + 1, (F.col("col_end") - F.col("col_start")).cast("int"))).alias("same"),
        F.bool_and(F.col("start_pos").eqNullSafe(begin) & (F.col("aln_size") == own(F.col("piece_text")))).alias("own_ok"),
        F.first(F.length("text")).alias("n"),
    )
    later = F.expr("transform(sequence(1, size(x) - 1), i -> x[i].col_start = x[i - 1].col_end - 50 and x[i].col_end > x[i - 1].col_end and x[i].piece_no = i)")
    whole = (F.col("x")[0]["col_start"] == 0) & (F.element_at("x", -1)["col_end"] == F.col("n")) & F.col("same")
    return per.select("comp_id", (F.col("longest") <= 1000).alias("limit_ok"), F.forall(later, lambda v: v).alias("overlap_ok"), whole.alias("whole_ok"), "own_ok")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's ids, decoded, are its text again."""
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("doc"), "text")
    back = decoded_texts(token_ids(docs, "doc"), "doc")
    return back.select("doc.doc_id", (F.col("doc.text") == F.col("text")).alias("same"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents placed, containers over the capacity, short documents divided, documents not whole, and whether at most 2 % is unused."""
    placed = stage(p8_containers(spark, sf_dir), "placed").df
    loads = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("load")).where("load > 0")
    full = loads.agg(F.count("*").alias("n"), F.sum("load").alias("load"), F.count_if(F.col("load") > CAPACITY).alias("n_over"))
    whole = placed.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("n_tokens").alias("load"), F.max(F.col("start_token") + F.col("n_tokens")).alias("last"), F.count_distinct("piece_no").alias("k")
    )
    docs = whole.agg(
        F.count("*").alias("n_documents"),
        F.count_if((F.col("n") > 1) & (F.col("load") <= CAPACITY)).alias("n_divided"),
        F.count_if((F.col("last") != F.col("load")) | (F.col("k") != F.col("n"))).alias("n_broken"),
    )
    tight = F.col("n") * CAPACITY * 98 <= F.col("load") * 100 + CAPACITY * 98  # but for the last container
    return docs.join(full, F.lit(True)).select("n_documents", "n_over", "n_divided", "n_broken", tight.alias("tight"))  # one row each


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_label"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).select("doc_id", "read_level")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p4_combined, p4_found, p4_percentiles, p5_found, p5_pieces, p5_pieces_hold, p7_ids, p7_round_trip, p8_containers, p8_report, p9_found, p9_levels,
    )
}

_P = ", ".join(PEAK)
_USABLE = "{0} >= 0 and not isnan({0}) and not isinf({0})"
_PCT = f"""
with p as (select {_P} from narrow_peak where chrom is not null group by all),
u as (select chrom, 'signalvalue' field, signalvalue v from p union all select chrom, 'pvalue', pvalue from p),
r as (select *, row_number() over (partition by chrom, field order by v) k, count(*) over (partition by chrom, field) n
  from u where {_USABLE.format("v")}),
t as (select chrom, field, cast(pct as int) pct, n, v as "value" from r, (values (50), (90), (99)) s(pct)
  where n >= {MIN_VALUES} and k = (n * pct + 99) // 100)
"""
SQL = {
    "p4_combined": f"{_PCT} select chrom, field, pct, n, true kept from t",
    "p7_round_trip": "select doc_id, true same from documents",
    "p8_report": "select count(*) n_documents, cast(0 as bigint) n_over, cast(0 as bigint) n_divided, cast(0 as bigint) n_broken, true tight from documents",
    "p1_found": f"""with p as (select {_P}, min(rec_id) rec_id from narrow_peak where chrom is not null and
        {_USABLE.format("signalvalue")} group by all),
        q as (select *, row_number() over (partition by chrom order by signalvalue desc, score desc nulls last, rec_id) k from p)
        select chrom, rec_id from q where k <= {TOP}""",
    "p4_percentiles": f"{_PCT} select * from t",
    "p5_found": """with recursive t as (select comp_id, length(text) n, list_filter(range(5, length(text)),
          lambda i: text[i - 4:i] = '-----' and text[i + 1] <> '-') b from maf_component where length(text) > 1000),
        r as (select comp_id, n, b, cast(0 as bigint) s, cast(0 as bigint) e, false stuck from t
          union all select comp_id, n, b, coalesce(e2 - 50, 0), coalesce(e2, 0), e2 is null
          from (select *, list_max(list_filter(b, lambda x: x > e and x <= s + 1000)) e2 from r where not stuck and n - s > 1000))
        select comp_id, max(cast(stuck as int)) forced from r group by comp_id""",
    "p5_pieces_hold": """select comp_id, true limit_ok, true overlap_ok, true whole_ok, true own_ok from maf_component where length(text) > 1000""",
    "p4_found": f"""{_PCT} select t.chrom, t.field, t.pct from t join pct_bound b on t.field = b.field and t.pct = b.pct
        where t."value" > b.bound""",
}
