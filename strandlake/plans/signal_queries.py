"""Queries on signal, genes and lift-over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import alignment as L
from strandlake.operators import genes as G
from strandlake.operators import liftover as C
from strandlake.operators import ranges as R
from strandlake.operators import signal as S
from strandlake.plans.problems import SQL as P_SQL
from strandlake.plans.tables import table, usable
from strandlake.sources.gene_lines import gene_records

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _signal(spark: SparkSession, d: str) -> DataFrame:
    rows = R.valid(table(spark, d, "narrow_peak")).where(usable("signalvalue"))
    # Tenths as whole numbers: sums are exact, whatever their order.
    return rows.select("rec_id", "chrom", "start_pos", "end_pos", F.rint(F.col("signalvalue") * 10).alias("value"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """The covered stretch of every sequence."""
    return R.valid(table(spark, d, "narrow_peak")).groupBy("chrom").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).withColumn("name", F.col("chrom"))


_V = """with sg as (select rec_id, chrom, start_pos, end_pos, round_even(signalvalue * 10, 0) "value" from narrow_peak where chrom is not null and start_pos < end_pos
  and signalvalue >= 0 and not isnan(signalvalue) and not isinf(signalvalue)),
rg as (select chrom, min(start_pos) start_pos, max(end_pos) end_pos from narrow_peak where chrom is not null and start_pos < end_pos group by 1)"""
_BINS = _V + """, bn as (select chrom name, chrom, bin, start_pos + bin * w start_pos, start_pos + bin * w + w end_pos, w from
  (select *, (end_pos - start_pos) // 20 w from rg), unnest(range(20)) t(bin) where w > 0),
ov as (select b.name, b.bin, s."value" v, least(b.end_pos, s.end_pos) - greatest(b.start_pos, s.start_pos) n from bn b join sg s on s.chrom = b.chrom
  and s.end_pos > b.start_pos and s.start_pos < b.end_pos),
ag as (select name, bin, sum(n) n_valid, min(v) min_val, max(v) max_val, sum(v * n) sum_val, sum(v * v * n) sum_squares from ov group by 1, 2),
al as (select b.name, cast(b.bin as int) bin, w width, coalesce(cast(n_valid as bigint), 0) n_valid, min_val, max_val, coalesce(sum_val, 0.0) sum_val,
  coalesce(sum_squares, 0.0) sum_squares from bn b left join ag using (name, bin))"""


@query(_BINS + " select * from al")
def binned_summary(spark, d):
    return S.binned_summary(_signal(spark, d), _regions(spark, d), "name", 20)


@query(_BINS + """ select name, bin, case when n_valid > 0 then sum_val / n_valid end mean, max_val, min_val, n_valid / width coverage,
    case when n_valid > 1 then sqrt(greatest((sum_squares - sum_val * sum_val / n_valid) / (n_valid - 1), 0)) end std_dev from al""")
def summary_query(spark, d):
    return S.summary_query(_signal(spark, d), _regions(spark, d), "name", 20)


@query(_V + """, ov as (select r.chrom, s."value" v, s.end_pos - s.start_pos n from rg r join sg s using (chrom))
    select r.chrom name, sum(v * n) / sum(n) avg_val, min(v) min_val, max(v) max_val from rg r left join ov using (chrom) group by 1""")
def interval_scores(spark, d):
    return S.interval_scores(_signal(spark, d), _regions(spark, d), "name")


@query(_V + """, st as (select rec_id, chrom, o "offset", (start_pos + end_pos) // 2 + o a from sg, unnest(range(-200, 200, 50)) t(o)),
    ov as (select "offset", s."value" v, least(a + 50, s.end_pos) - greatest(a, s.start_pos) n from st join sg s on s.chrom = st.chrom and s.end_pos > a and s.start_pos < a + 50)
    select cast("offset" as int) "offset", sum(v * n) / sum(n) mean, cast(sum(n) as bigint) n_bases from ov group by 1""")
def signal_profile(spark, d):
    s = _signal(spark, d)
    return S.profile(s, s.drop("value"), "rec_id", 200, 50)


@query(_V + """, l as (select unnest([1000, 10000, 100000]) "level") select cast("level" as int) "level", chrom, start_pos // "level" bin, count(*) n, min("value") min_val,
    max("value") max_val, sum("value") sum_val, sum("value" * "value") sum_squares from sg, l group by 1, 2, 3""")
def rollup_summary(spark, d):
    return S.levels(_signal(spark, d), [1000, 10000, 100000])


@query(_V + """, p as (select distinct chrom, (start_pos + end_pos) // 2 pos from sg), f as (select p.chrom, p.pos, avg("value") v from p join sg s on s.chrom = p.chrom
    and s.start_pos <= pos and s.end_pos > pos group by 1, 2) select p.chrom, p.pos, v "value" from p left join f using (chrom, pos)""")
def signal_at_positions(spark, d):
    s = _signal(spark, d)
    at = s.select("chrom", F.expr("(start_pos + end_pos) div 2").alias("pos")).distinct()
    return S.at_positions(s, at)


_G = P_SQL["p3_genes"].rstrip()
_GENE = f"""with gn as ({_G}),
bl as (select line_id, chrom, strand, cds_start, cds_end, chrom_start + cast(s as bigint) s, chrom_start + cast(s as bigint) + cast(z as bigint) e from
  (select *, unnest(string_split(block_starts, ',')) s, unnest(string_split(block_sizes, ',')) z from gn)),
b1 as (select distinct line_id, chrom, strand, cds_start, cds_end, s, e from bl),
b2 as (select *, max(e) over (partition by line_id order by s, e rows between unbounded preceding and 1 preceding) m from b1),
b3 as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by line_id order by s, e rows unbounded preceding) g from b2),
mg as (select line_id, chrom, strand, any_value(cds_start) ca, any_value(cds_end) cb, min(s) s, max(e) e from b3 group by line_id, chrom, strand, g)"""


def _genes(spark: SparkSession, d: str) -> DataFrame:
    return gene_records(table(spark, d, "gene_line"))


@query(_GENE + " select line_id, chrom, strand, s start_pos, e end_pos from bl")
def exons(spark, d):
    return G.exons(_genes(spark, d)).select("line_id", "chrom", "strand", "start_pos", "end_pos")


@query(_GENE + ", n as (select *, lead(s) over (partition by line_id order by s) nx from mg) select line_id, chrom, strand, e start_pos, nx end_pos from n where nx is not null")
def introns(spark, d):
    return G.introns(_genes(spark, d))


@query(_GENE + """, c as (select line_id, chrom, strand, greatest(s, ca) s, least(e, cb) e from mg where greatest(s, ca) < least(e, cb)),
    t as (select *, sum(e - s) over (partition by line_id) % 3 x, coalesce(sum(e - s) over (partition by line_id order by s rows between unbounded preceding and 1 preceding), 0) bf,
    coalesce(sum(e - s) over (partition by line_id order by s desc rows between unbounded preceding and 1 preceding), 0) af from c),
    k as (select line_id, chrom, strand, s + case when strand = '-' then greatest(x - bf, 0) else 0 end start_pos, e - case when strand = '-' then 0 else greatest(x - af, 0) end end_pos from t)
    select line_id, chrom, strand, cast(start_pos as bigint) start_pos, cast(end_pos as bigint) end_pos from k where start_pos < end_pos""")
def cds_trim(spark, d):
    return G.coding_exons(_genes(spark, d))


@query(f"""with gn as ({_G}), r as (select line_id, chrom, strand, 'coding' kind, cds_start s, cds_end e from gn union all select line_id, chrom, strand, 'transcribed', chrom_start, chrom_end from gn
    union all select line_id, chrom, strand, 'utr5', case when strand = '-' then cds_end else chrom_start end, case when strand = '-' then chrom_end else cds_start end from gn
    union all select line_id, chrom, strand, 'utr3', case when strand = '-' then chrom_start else cds_end end, case when strand = '-' then cds_start else chrom_end end from gn)
    select line_id, chrom, strand, s start_pos, e end_pos, kind from r where s < e""")
def gene_regions(spark, d):
    genes, out = _genes(spark, d), None
    for kind in ("coding", "transcribed", "utr5", "utr3"):
        part = G.regions(genes, kind).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


_CODE = "case codon " + " ".join(f"when '{c}' then '{a}'" for c, a in G.genetic_code().items()) + " end"


@query(f"""with t as (select comp_id, upper(replace(text, '-', '')) s from maf_component where text is not null),
    c as (select comp_id, i codon_no, s[3 * i + 1:3 * i + 3] codon from t, unnest(range(length(s) // 3)) u(i))
    select comp_id, cast(codon_no as int) codon_no, codon, {_CODE} aa from c where {_CODE} is not null""")
def codon_degeneracy(spark, d):
    texts = table(spark, d, "maf_component").where("text is not null").select("comp_id", F.translate("text", "-", "").alias("s"))
    return G.codon_degeneracy(texts, "comp_id", "s").select("comp_id", "codon_no", "codon", "aa")


def _chains(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chain blocks of each aligned pair whose reference lies on the forward strand, and its middle part as the element to map."""
    c = table(spark, d, "maf_component")
    ref = c.where("comp_no = 0 and strand = '+' and src is not null and start_pos is not null").groupBy("block_id").agg(F.min(F.struct("comp_id", "src", "start_pos", "text")).alias("r"))
    q = c.where("comp_no > 0 and strand is not null and src is not null and start_pos is not null and src_size is not null and length(text) > 0")
    q = q.select("block_id", "comp_id", F.col("src").alias("q_name"), F.col("start_pos").alias("q0"), F.col("strand").alias("q_strand"), F.col("src_size").alias("q_size"), F.col("text").alias("text1"))
    pairs = q.join(ref, "block_id").withColumn("text0", F.col("r.text")).where("length(text0) = length(text1)")
    # Runs of columns without a gap on either side, by their first column.
    flag = F.array_join(F.zip_with(L.S.chars(F.col("text0")), L.S.chars(F.col("text1")), lambda a, b: F.when((a != "-") & (b != "-"), "x").when((a == "-") & (b == "-"), "-").when(a == "-", "q").otherwise("t")), "")
    runs = pairs.withColumn("parts", F.regexp_extract_all(F.regexp_replace(flag, "-", ""), F.lit("(x+|[qt]+)"), F.lit(1)))
    zero = F.struct(F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("q"), F.array().cast("array<struct<t:bigint,q:bigint,z:bigint>>").alias("out"))
    n_t = lambda p: F.length(F.translate(p, "q", "")).cast("bigint")
    n_q = lambda p: F.length(F.translate(p, "t", "")).cast("bigint")
    walk = F.aggregate(
        "parts", zero,
        lambda s, p: F.struct(
            (s["t"] + n_t(p)).alias("t"), (s["q"] + n_q(p)).alias("q"),
            F.when(F.startswith(p, F.lit("x")), F.concat(s["out"], F.array(F.struct(s["t"].alias("t"), s["q"].alias("q"), F.length(p).cast("bigint").alias("z"))))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    blocks = runs.select(
        F.col("comp_id").alias("chain_id"), F.lit(0).alias("score"), F.col("r.src").alias("t_name"), "q_name", "q_strand", "q_size", F.col("r.start_pos").alias("t0"), "q0",
        F.posexplode(walk).alias("block_no", "b"),
    ).select(
        "chain_id", "score", "t_name", "q_name", "q_strand", "q_size", "block_no", (F.col("t0") + F.col("b.t")).alias("t_start"),
        (F.col("t0") + F.col("b.t") + F.col("b.z")).alias("t_end"), (F.col("q0") + F.col("b.q")).alias("q_start"),
    )
    n = F.length(F.translate(F.col("r.text"), "-", "")).cast("bigint")
    elements = ref.select("block_id", F.col("r.src").alias("chrom"), (F.col("r.start_pos") + F.floor(n / 4)).alias("start_pos"), (F.col("r.start_pos") + n - F.floor(n / 4)).alias("end_pos"))
    return blocks, elements.where("start_pos < end_pos")


@query("""with rf as (select block_id, (min({'a': comp_id, 'src': src, 's': start_pos, 't': text})) r from maf_component where comp_no = 0 and strand = '+' and src is not null and start_pos is not null group by 1),
    q as (select m.*, r.src rsrc, r.s rs, r.t rt from maf_component m join rf using (block_id) where comp_no > 0 and strand is not null and src is not null and start_pos is not null
      and src_size is not null and length(text) > 0 and length(text) = length(r.t)),
    cl as (select comp_id, src, strand, src_size, rsrc, i, rt[i] <> '-' bt, text[i] <> '-' bq, rs, start_pos from q, unnest(range(1, length(text) + 1)) t(i)),
    cp as (select *, rs + sum(case when bt then 1 else 0 end) over w - 1 tp, start_pos + sum(case when bq then 1 else 0 end) over w - 1 qp from cl window w as (partition by comp_id order by i rows unbounded preceding)),
    mp as (select comp_id, src, rsrc, tp, case when strand = '-' then src_size - 1 - qp else qp end fq from cp where bt and bq),
    el as (select block_id, r.src chrom, r.s + length(replace(r.t, '-', '')) // 4 s, r.s + length(replace(r.t, '-', '')) - length(replace(r.t, '-', '')) // 4 e from rf where r.t is not null),
    h as (select block_id, comp_id, src, min(fq) a, max(fq) + 1 b, count(*) n, any_value(e - s) w from el join mp on rsrc = chrom and tp >= s and tp < e where s < e group by 1, 2, 3),
    k as (select *, count(*) over (partition by block_id) c from h)
    select block_id, comp_id chain_id, src chrom, cast(a as bigint) start_pos, cast(b as bigint) end_pos, n mapped from k where c = 1 and n >= w * 0.5""")
def liftover(spark, d):
    blocks, elements = _chains(spark, d)
    return C.liftover(elements, blocks, "block_id", threshold=0.5).select("block_id", "chain_id", "chrom", "start_pos", "end_pos", "mapped")


QUERIES = Q
