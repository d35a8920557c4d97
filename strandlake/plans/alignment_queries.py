"""Queries on alignment components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.operators import alignment as L
from strandlake.plans.tables import table
from strandlake.session import with_once

Q, SQL = {}, {}
CODES = {"A": 0, "C": 1, "G": 2, "T": 3}
# Scores of a match, of a transition and of a transversion.
MATRIX = {(a, b): 91 if a == b else -31 if {a, b} in ({"A", "G"}, {"C", "T"}) else -114 for a in "ACGT" for b in "ACGT"}
GAP_OPEN, GAP_EXTEND = 400, 30


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def comps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "maf_component")


_UNGAP = "cast(length(replace({0}, '-', '')) as bigint)"
_PAIRS = """with r as (select * from maf_component where length(text) > 0),
f as (select block_id, arg_min(text, comp_id) text0 from r where comp_no = 0 group by block_id),
pr as (select r.block_id, r.comp_no, r.comp_id, r.src, r.text text1, f.text0 from r join f using (block_id) where comp_no > 0 and length(text0) = length(r.text)),
cols as (select comp_id, i, upper(text0[i]) c0, upper(text1[i]) c1 from pr, unnest(range(1, length(text0) + 1)) t(i))"""


@query("select comp_id, src, regexp_replace(src, '\\.[^.]*$', '') species, case when contains(src, '.') then regexp_extract(src, '[^.]*$') end \"sequence\" from maf_component")
def src_split(spark, d):
    return comps(spark, d).select("comp_id", "src", S.src_species(F.col("src")).alias("species"), S.src_sequence(F.col("src")).alias("sequence"))


@query("""select comp_id, case when strand = '-' then src_size - start_pos - aln_size else start_pos end fwd_start,
    case when strand = '-' then src_size - start_pos else start_pos + aln_size end fwd_end from maf_component""")
def forward_coordinates(spark, d):
    args = [F.col(c) for c in ("start_pos", "aln_size", "strand", "src_size")]
    return comps(spark, d).select("comp_id", S.forward_start(*args).alias("fwd_start"), S.forward_end(*args).alias("fwd_end"))


@query("select comp_id, reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) rc from maf_component")
def reverse_complement_text(spark, d):
    return comps(spark, d).select("comp_id", S.reverse_complement(F.col("text")).alias("rc"))


@query("""select comp_id, src_size - start_pos - aln_size start_pos, case strand when '+' then '-' when '-' then '+' else strand end strand,
    reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) text, right_status left_status, left_status right_status from maf_component""")
def reverse_complement_blocks(spark, d):
    return L.reverse_complement(comps(spark, d)).select("comp_id", "start_pos", "strand", "text", "left_status", "right_status")


@query("""with s as (select name, length, unnest([0, length // 3, length // 2]) a from chrom_size where length > 0), w as (select *, unnest([1, 100000, 3000000]) n from s)
    select name, a start_pos, a + n end_pos, cast(case when a >> 17 = (a + n - 1) >> 17 then 4681 + (a >> 17) when a >> 20 = (a + n - 1) >> 20 then 585 + (a >> 20)
    when a >> 23 = (a + n - 1) >> 23 then 73 + (a >> 23) when a >> 26 = (a + n - 1) >> 26 then 9 + (a >> 26)
    when a >> 29 = (a + n - 1) >> 29 then 1 + (a >> 29) else 0 end as bigint) bin from w""")
def bin_for_range(spark, d):
    sizes = table(spark, d, "chrom_size").where("length > 0")
    at = sizes.select("name", F.explode(F.array(F.lit(0).cast("bigint"), F.expr("length div 3"), F.expr("length div 2"))).alias("start_pos"))
    ranges = at.select("name", "start_pos", F.explode(F.array(*[F.col("start_pos") + n for n in (1, 100000, 3000000)])).alias("end_pos"))
    return ranges.withColumn("bin", S.bin_for_range(F.col("start_pos"), F.col("end_pos")))


@query("""select comp_id, list_transform(string_split(text, ''), lambda c: case c when 'A' then 0 when 'C' then 1 when 'G' then 2 when 'T' then 3 else -1 end) codes
    from maf_component where length(text) > 0""")
def char_codes(spark, d):
    return comps(spark, d).where("length(text) > 0").select("comp_id", S.char_codes(F.col("text"), CODES).alias("codes"))


@query("""select block_id, count(*) n_components, max(length(text)) text_size, cast(sum(length(text)) as bigint) n_chars,
    cast(sum(length(replace(text, '-', ''))) as bigint) n_bases from maf_component group by block_id""")
def block_counts(spark, d):
    t = F.col("text")
    return comps(spark, d).groupBy("block_id").agg(
        F.count("*").alias("n_components"), F.max(F.length(t)).cast("bigint").alias("text_size"), F.sum(F.length(t)).alias("n_chars"),
        F.sum(F.length(F.translate(t, "-", ""))).alias("n_bases"),
    )


@query("select * exclude (text) from maf_component where regexp_replace(src, '\\.[^.]*$', '') in ('narBel4', 'vulTor2')")
def limit_to_species(spark, d):
    return L.limit_to_species(comps(spark, d), ["narBel4", "vulTor2"]).drop("text")


@query("""with k as (select block_id from maf_component group by 1 having coalesce(max(length(text)), 0) >= 50 and count(*) = 3)
    select comp_id, block_id from maf_component where block_id in (select block_id from k)""")
def filter_blocks(spark, d):
    return L.filter_blocks(comps(spark, d), n_components=3, min_columns=50).select("comp_id", "block_id")


@query("""with r as (select * from maf_component where length(text) > 0),
    g as (select block_id, max(length(text)) w from r group by 1),
    c as (select g.block_id, i, string_agg(text[i], '' order by comp_no, comp_id) "column" from g join r using (block_id), unnest(range(1, w + 1)) t(i) group by 1, 2)
    select "column", count(*) n from c group by 1""")
def col_counts(spark, d):
    return L.column_counts(comps(spark, d))


@query("""with w as (select unnest(list_transform(range(1, length(text) - 1), lambda i: text[i:i + 2])) word from maf_component where length(text) >= 3),
    c as (select word, count(*) n from w group by word) select word, n, n / (sum(n) over ()) frequency from c""")
def ngram_counts(spark, d):
    return L.ngram_counts(comps(spark, d), "text", 3)


@query(_PAIRS + """, k as (select comp_id, count(*) filter (c0 <> '-' and c1 <> '-') na, count(*) filter (c0 <> '-' and c1 <> '-' and c0 = c1) nm, count(*) n from cols group by 1)
    select comp_id, nm n_match, na n_aligned, case when na > 0 then nm / na end "identity", 1 - na / n gap_fraction from k""")
def percent_identity(spark, d):
    return L.pair_identity(L.pairs_with_first(comps(spark, d))).select("comp_id", "n_match", "n_aligned", "identity", "gap_fraction")


_NP = "length(text) - length(translate(upper(text), '{0}', ''))"


@query(f"""with k as (select comp_id, {_UNGAP.format('text')} nb, length(text) n, {_NP.format('GC')} gc, {_NP.format('ACGT')} acgt,
    len(regexp_extract_all(text, '[^-]+')) runs from maf_component where length(text) > 0)
    select comp_id, nb n_bases, n - nb n_gaps, case when acgt > 0 then gc / acgt end gc_fraction, case when runs > 0 then nb / runs end mean_run from k""")
def base_composition(spark, d):
    return L.base_composition(comps(spark, d)).drop("block_id", "comp_no")


@query(f"""select comp_id, case when text is not null then start_pos + {_UNGAP.format('text[1:10]')} else start_pos end start_pos,
    case when text is not null then {_UNGAP.format('text[11:40]')} else 0 end aln_size, text[11:40] text from maf_component""")
def slice_columns(spark, d):
    return L.slice_columns(comps(spark, d), F.lit(10), F.lit(40)).select("comp_id", "start_pos", "aln_size", "text")


@query(f"""with r as (select * from maf_component where comp_no = 0 and text is not null),
    f as (select block_id, arg_min(text, comp_id) t, arg_min(start_pos, comp_id) s from r group by 1),
    p as (select block_id, t, length(replace(t, '-', '')) n, list_filter(range(1, length(t) + 1), lambda i: t[i] <> '-') pos from f where s is not null),
    c as (select block_id, case when n > 5 then pos[6] - 1 else length(t) end lo, case when n > 25 then pos[26] - 1 else length(t) end hi from p where n >= 5)
    select m.comp_id, case when m.text is not null then m.start_pos + {_UNGAP.format('m.text[1:lo]')} else m.start_pos end start_pos,
    case when m.text is not null then {_UNGAP.format('m.text[lo + 1:hi]')} else 0 end aln_size, m.text[lo + 1:hi] text
    from c join maf_component m using (block_id) where lo < hi""")
def slice_by_coord(spark, d):
    c = comps(spark, d)
    ref = c.where("comp_no = 0 and text is not null").groupBy("block_id").agg(F.min(F.struct("comp_id", "start_pos"))["start_pos"].alias("s"))
    regions = ref.where("s is not null").select("block_id", (F.col("s") + 5).alias("ref_start"), (F.col("s") + 25).alias("ref_end"))
    return L.slice_by_reference(c, regions).select("comp_id", "start_pos", "aln_size", "text")


@query("""with sp as (select * from maf_component where regexp_replace(src, '\\.[^.]*$', '') in ('narBel4', 'oskMin1')),
    cols as (select comp_id, block_id, i, text[i] ch from sp, unnest(range(1, length(text) + 1)) t(i)),
    keep as (select distinct block_id, i from cols where ch <> '-'),
    j as (select comp_id, string_agg(coalesce(ch, ''), '' order by i) t from cols semi join keep using (block_id, i) group by 1)
    select comp_id, case when text is null then null else coalesce(t, '') end text from sp left join j using (comp_id)""")
def remove_gap_columns(spark, d):
    return L.remove_gap_columns(L.limit_to_species(comps(spark, d), ["narBel4", "oskMin1"])).select("comp_id", "text")


@query(_PAIRS + """, flag as (select *, lead(c0) over w n0, lead(c1) over w n1, lag(c0) over w p0, lag(c1) over w p1 from cols window w as (partition by comp_id order by i))
    select comp_id, string_agg(case when pr.text1[i] <> '-' and ((c0 = 'C' and n0 = 'G') or (c0 = 'G' and p0 = 'C') or (c1 = 'C' and n1 = 'G') or (c1 = 'G' and p1 = 'C'))
    then '#' else pr.text1[i] end, '' order by i) masked from flag join pr using (comp_id) group by 1""")
def cpg_mask(spark, d):
    p = L.pairs_with_first(comps(spark, d))
    return p.select("comp_id", L.mask_columns(F.col("text1"), L.cpg_columns(F.col("text0"), F.col("text1"))).alias("masked"))


_SCORE = "case " + " ".join(f"when c0 = '{a}' and c1 = '{b}' then {s}" for (a, b), s in MATRIX.items()) + " else 0 end"


@query(_PAIRS + f""", k as (select comp_id, i, c0, c1, c0 = '-' g0, c1 = '-' g1 from cols where not (c0 = '-' and c1 = '-')),
    s as (select *, lag(g0) over w p0, lag(g1) over w p1 from k window w as (partition by comp_id order by i))
    select comp_id, cast(sum(case when g0 then -({GAP_EXTEND} + case when coalesce(p0, false) then 0 else {GAP_OPEN} end)
    when g1 then -({GAP_EXTEND} + case when coalesce(p1, false) then 0 else {GAP_OPEN} end) else {_SCORE} end) as bigint) score from s group by 1""")
def pair_score(spark, d):
    p = L.pairs_with_first(comps(spark, d))
    return p.select("comp_id", L.pair_score(F.col("text0"), F.col("text1"), MATRIX, GAP_OPEN, GAP_EXTEND).alias("score"))


@query(_PAIRS + f""", k as (select comp_id, i, c0, c1, c0 = '-' g0, c1 = '-' g1 from cols where not (c0 = '-' and c1 = '-')),
    s as (select *, lag(g0) over w p0, lag(g1) over w p1 from k window w as (partition by comp_id order by i)),
    u as (select comp_id, i, g0, sum(case when g0 then -({GAP_EXTEND} + case when coalesce(p0, false) then 0 else {GAP_OPEN} end)
    when g1 then -({GAP_EXTEND} + case when coalesce(p1, false) then 0 else {GAP_OPEN} end) else {_SCORE} end) over (partition by comp_id order by i) score from s),
    n as (select comp_id, score, row_number() over (partition by comp_id order by i) - 1 col from u where not g0)
    select comp_id, col, cast(score as bigint) score from n where col % 100 = 0""")
def running_scores(spark, d):
    """Every 100th score along the reference's bases."""
    out = L.running_scores(L.pairs_with_first(comps(spark, d)), ["comp_id"], "text0", "text1", MATRIX, GAP_OPEN, GAP_EXTEND, skip_gaps=True)
    return out.select("comp_id", F.posexplode("scores").alias("col", "score")).where("col % 100 = 0").select("comp_id", F.col("col").cast("bigint").alias("col"), "score")


@query("""with c as (select comp_id, i, text[i] = '-' v from maf_component, unnest(range(1, length(text) + 1)) t(i) where length(text) > 0),
    g as (select *, i - row_number() over (partition by comp_id, v order by i) g from c)
    select comp_id, v gap, cast(min(i) - 1 as int) col_start, cast(max(i) as int) col_end from g group by comp_id, v, g""")
def mask_runs(spark, d):
    flags = F.transform(L.S.chars(F.col("text")), lambda c: c == "-")
    masks = with_once(comps(spark, d).where("length(text) > 0").select("comp_id", "text"), "mask", flags)
    runs = masks.select("comp_id", F.inline(L.mask_runs(F.col("mask"))))
    return runs.select("comp_id", F.col("value").alias("gap"), F.col("start").alias("col_start"), F.col("end").alias("col_end"))


@query("""with f as (select *, row_number() over (partition by block_id order by comp_no, comp_id) k from maf_component where starts_with(src, 'vulTor2.'))
    select block_id, comp_id, src, start_pos from f where k = 1""")
def component_by_source(spark, d):
    return L.by_source(comps(spark, d), "vulTor2.", prefix=True).select("block_id", "comp_id", "src", "start_pos")


@query()
def fuse_blocks(spark, d):
    return L.fuse(comps(spark, d))


@query("select comp_id, translate(text, '#=X@', '-***') text from maf_component")
def translate_fill(spark, d):
    return comps(spark, d).select("comp_id", L.translate_fill(F.col("text")).alias("text"))


@query("""with w as (select block_id, max(length(text)) w from maf_component group by 1 having max(length(text)) > 0), s(species) as (values ('narBel4'), ('vulTor2')),
    o as (select block_id, regexp_replace(src, '\\.[^.]*$', '') species, (min({'a': comp_no, 'b': comp_id, 't': text})).t t from maf_component where length(text) > 0 group by 1, 2)
    select species, block_id, coalesce(t, repeat('-', w)) text from w cross join s left join o using (block_id, species)""")
def concat_species(spark, d):
    return L.concat_species(comps(spark, d), ["narBel4", "vulTor2"])


@query("""select comp_id, len(list_filter(range(1, length(text) - 4), lambda i: regexp_matches(upper(text[i:i + 5]), '^T[AG]C[CT][AGT][ACGT]$'))) n_hits
    from maf_component where length(text) >= 6""")
def motif_consensus(spark, d):
    """How often an ambiguity-code motif begins in a text."""
    hit = f"(?={S.consensus_pattern('TRCYDN')})"
    return comps(spark, d).where("length(text) >= 6").select("comp_id", F.regexp_count(F.upper("text"), F.lit(hit)).cast("bigint").alias("n_hits"))


QUERIES = Q
