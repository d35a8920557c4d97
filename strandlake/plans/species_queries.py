"""Per-species queries on alignment blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import alignment as L
from strandlake.operators import ranges as R
from strandlake.operators import species as A
from strandlake.plans import alignment_queries
from strandlake.plans.tables import table

Q, SQL = {}, {}
_REF = """with rr as (select block_id, (min({'a': comp_id, 'src': src, 's': start_pos, 'z': aln_size, 'st': strand, 'n': src_size})) r from maf_component
    where comp_no = 0 and src is not null and start_pos is not null and aln_size > 0 and length(text) > 0 group by 1),
  rs0 as (select block_id, r.src chrom, case when r.st = '-' then r.n - r.s - r.z else r.s end start_pos, case when r.st = '-' then r.n - r.s else r.s + r.z end end_pos from rr),
  rs as (select * from rs0 where start_pos < end_pos)"""
_SP = "regexp_replace(src, '\\.[^.]*$', '')"


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_REF + " select * from rs")
def reference_spans(spark, d):
    return A.reference_spans(table(spark, d, "maf_component"))


@query(_REF + f""", h as (select distinct block_id, {_SP} species from maf_component where length(text) > 0 and src is not null),
    p as (select h.species, rs.chrom, unnest(range(start_pos, end_pos)) p from rs join h using (block_id)), u as (select distinct * from p),
    g as (select chrom, min(start_pos) a, max(end_pos) b from rs group by 1)
    select g.chrom "region", u.species, count(*) / any_value(b - a) fraction from g join u on u.chrom = g.chrom and p >= a and p < b group by 1, 2""")
def region_coverage(spark, d):
    c = table(spark, d, "maf_component")
    regions = A.reference_spans(c).groupBy("chrom").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).withColumn("region", F.col("chrom"))
    return A.region_coverage(c, regions, "region")


@query("""with r as (select * from maf_component where length(text) > 0),
    f as (select block_id, arg_min(text, comp_id) t0 from r where comp_no = 0 group by 1),
    s as (select block_id, (min({'a': comp_id, 'c': src, 's': start_pos})) x from maf_component where comp_no = 0 and strand = '+' and src is not null and start_pos is not null group by 1),
    j as (select r.comp_id, """ + _SP.replace("src", "r.src") + """ species, x.c chrom, x.s s, t0, r.text t1 from r join f using (block_id) join s using (block_id) where comp_no > 0 and r.src is not null and length(t0) = length(r.text)),
    k as (select species, chrom, comp_id, i, s + sum(case when t0[i] <> '-' then 1 else 0 end) over (partition by comp_id order by i rows unbounded preceding) - 1 p, upper(t0[i]) a, upper(t1[i]) b from j, unnest(range(1, length(t0) + 1)) t(i)),
    u as (select distinct species, chrom, cast(p as bigint) p from k where a in ('A', 'C', 'G', 'T') and b in ('A', 'C', 'G', 'T') and a <> b),
    g as (select *, p - row_number() over (partition by species, chrom order by p) n from u)
    select species, chrom, min(p) start_pos, max(p) + 1 end_pos from g group by species, chrom, n""")
def divergent_sites(spark, d):
    return A.divergent_sites(table(spark, d, "maf_component"))


@query(f"""with t as (select distinct {_SP} species, n_components k from maf_component join maf_block using (block_id) where src is not null),
    n as (select count(distinct n_components) n from maf_component join maf_block using (block_id)) select species from t, n group by species, n having count(distinct k) = n""")
def species_in_all(spark, d):
    """Species that occur in blocks of every size (the number of components stands for a file)."""
    c = table(spark, d, "maf_component").join(table(spark, d, "maf_block").select("block_id", "n_components"), "block_id")
    return A.species_in_all(c, "n_components")


@query("with c as (select n_components idx, count(*) n from maf_block group by 1) select cast(i as bigint) idx, coalesce(n, 0) n from range(12) t(i) left join c on c.idx = i")
def counts_with_zeros(spark, d):
    return A.counts_with_zeros(table(spark, d, "maf_block"), "n_components", 12)


@query(_REF + """, g as (select block_id chrom, chrom c, start_pos a, end_pos b from rs),
    pc as (select g.chrom, greatest(a, rs.start_pos) s, least(b, rs.end_pos) e, rs.block_id, coalesce(score, '-inf'::double) score from g join rs on rs.chrom = g.c and rs.start_pos < b and rs.end_pos > a
      left join maf_block on maf_block.block_id = rs.block_id),
    mk as (select chrom, a p from g union select chrom, b from g union select chrom, s from pc union select chrom, e from pc),
    cl as (select chrom, p s, lead(p) over (partition by chrom order by p) e from mk),
    bs as (select cl.chrom, cl.s, cl.e, (max({'s': score, 'b': block_id})).b block_id from cl left join pc on pc.chrom = cl.chrom and pc.s < cl.e and pc.e > cl.s where cl.e is not null group by 1, 2, 3),
    nw as (select *, case when block_id is not distinct from lag(block_id) over w and row_number() over w > 1 then 0 else 1 end nw from bs window w as (partition by chrom order by s)),
    rn as (select *, sum(nw) over (partition by chrom order by s rows unbounded preceding) r from nw)
    select chrom "region", min(s) start_pos, max(e) end_pos, block_id from rn group by chrom, r, block_id""")
def tile_plan(spark, d):
    """The best block along the reference span of every block."""
    spans = A.reference_spans(table(spark, d, "maf_component"))
    scored = spans.join(table(spark, d, "maf_block").select("block_id", "score"), "block_id", "left")
    return A.tile_plan(spans.withColumnRenamed("block_id", "region"), scored, "region")


@query(_REF + f""", ds as ({SQL["divergent_sites"]}), p as (select distinct species, chrom, unnest(range(start_pos, end_pos)) p from ds where species in ('oskMin1', 'vulTor2')),
    nt as (select distinct chrom, unnest(range(start_pos, start_pos + (end_pos - start_pos) // 2)) p from rs), q as (select p.*, nt.p is not null ar from p left join nt using (chrom, p)),
    k as (select block_id, species, count(*) n, count(*) filter (ar) m from rs join q on q.chrom = rs.chrom and q.p >= start_pos and q.p < end_pos group by 1, 2)
    select rs.block_id, coalesce(a.n, 0) snp, coalesce(a.m, 0) ar_snp, coalesce(b.n, 0) div, coalesce(b.m, 0) ar_div from rs
    left join k a on a.block_id = rs.block_id and a.species = 'oskMin1' left join k b on b.block_id = rs.block_id and b.species = 'vulTor2'""")
def divergence_table(spark, d):
    c = table(spark, d, "maf_component")
    sites = A.divergent_sites(c)
    spans = A.reference_spans(c)
    windows = spans.select(F.col("block_id"), "chrom", "start_pos", "end_pos")
    one, other = sites.where("species = 'oskMin1'"), sites.where("species = 'vulTor2'")
    half = spans.withColumn("end_pos", F.expr("start_pos + (end_pos - start_pos) div 2"))
    return A.divergence_table(windows, one, other, R.valid(half), "block_id").select("block_id", "snp", "ar_snp", "div", "ar_div")


@query(_REF + f""", i as ({alignment_queries.SQL["percent_identity"]}) select comp_id, src, chrom, rs.start_pos, rs.end_pos, i."identity"
    from i join maf_component m using (comp_id) join rs using (block_id) where i."identity" > 0""")
def covered_regions(spark, d):
    return A.covered_regions(table(spark, d, "maf_component"))


@query("""with c as (select block_id, i, count(*) filter (text[i] = '-') w from maf_component, unnest(range(1, length(text) + 1)) t(i) where length(text) > 0 group by 1, 2),
    k as (select block_id from c group by 1 having count(*) filter (w <= 1) >= 50) select comp_id from maf_component join k using (block_id)""")
def max_wildcards(spark, d):
    return L.max_wildcards(table(spark, d, "maf_component"), min_good=50, max_wild=1, wild="-").select("comp_id")


QUERIES = Q
