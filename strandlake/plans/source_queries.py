"""Sources and sinks by round trip: the project's tables are written as text, read back and compared with the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import genes as G
from strandlake.operators import liftover as C
from strandlake.operators import ranges as R
from strandlake.plans.tables import table, usable
from strandlake.session import shared_dir
from strandlake.sinks import text as K
from strandlake.sources import blocks as X
from strandlake.sources import sequences as Q_
from strandlake.sources import text as T
from strandlake.sources.gene_lines import gene_records

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _file(lines: DataFrame | Column, df: DataFrame | None = None) -> str:
    """Writes lines (a frame of one text column, or a column of ``df``) and returns their folder."""
    out = lines if df is None else df.select(lines.alias("value"))
    path = f"{shared_dir(out.sparkSession)}/text-{uuid.uuid4().hex}"
    out.write.text(path)
    return path


def _bed6(spark: SparkSession, d: str) -> DataFrame:
    cells = ["chrom", "start_pos", "end_pos", "id", "score", "strand"]
    peaks = table(spark, d, "narrow_peak")
    return peaks.select(T.render([F.col(c) for c in cells]).alias("value"))


_LINE = """with l as (select coalesce(chrom, '.') chrom, start_pos, end_pos, coalesce(strand, '.') strand, coalesce(id, '.') id, coalesce(cast(score as varchar), '.') score from narrow_peak),
  e as (select *, case when start_pos is null then 'start is not a whole number' when end_pos is null then 'end is not a whole number'
    when end_pos < start_pos then 'end before start' when strand not in ('+', '-') then 'strand is neither + nor -' end error from l)"""


@query(_LINE + " select chrom, cast(start_pos as varchar) s, cast(end_pos as varchar) e, id, score from l where start_pos is not null and end_pos is not null")
def io_table(spark, d):
    rows = table(spark, d, "narrow_peak").where("start_pos is not null and end_pos is not null")
    lines = rows.select(F.concat(F.lit("# a remark\n"), T.render([F.col(c) for c in ("chrom", "start_pos", "end_pos", "id", "score")])).alias("value"))
    return T.read_table(spark, _file(lines), header=["chrom", "s", "e", "id", "score"])


@query(_LINE + " select error, count(*) n from e where error is not null group by error")
def io_bad_intervals(spark, d):
    return T.bad_intervals(spark, _file(_bed6(spark, d))).groupBy("error").agg(F.count("*").alias("n"))


@query(_LINE + " select chrom, start_pos, end_pos, strand, id from e where error is null")
def io_good_intervals(spark, d):
    return T.read_intervals(spark, _file(_bed6(spark, d))).select("chrom", "start_pos", "end_pos", "strand", F.col("fields")[3].alias("id"))


@query(_LINE + ", z as (select name, max(length) n from chrom_size group by name) select chrom, start_pos, end_pos from e left join z on chrom = name where error is null and (n is null or end_pos <= n)")
def io_intervals_in_bounds(spark, d):
    return T.read_intervals(spark, _file(_bed6(spark, d)), lengths=table(spark, d, "chrom_size")).select("chrom", "start_pos", "end_pos")


@query(_LINE + """, z as (select name, max(length) n from chrom_size group by name), p as (select chrom, greatest(start_pos - case when strand = '-' then 100 else 500 end, 0) s,
    end_pos + case when strand = '-' then 500 else 100 end e from e where error is null)
    select chrom, s start_pos, least(e, coalesce(n, 4611686018427387904)) end_pos from p left join z on chrom = name""")
def io_padded_clip(spark, d):
    rows = T.read_intervals(spark, _file(_bed6(spark, d))).select("chrom", "start_pos", "end_pos", "strand")
    return T.clip(R.pad(rows, 500, 100), table(spark, d, "chrom_size")).select("chrom", "start_pos", "end_pos")


@query("select name, length from chrom_size where name is not null and length is not null")
def io_lengths(spark, d):
    sizes = table(spark, d, "chrom_size").where("name is not null and length is not null")
    return T.read_lengths(spark, _file(F.concat_ws(" ", "name", F.col("length").cast("string")), sizes))


_WIG = "from narrow_peak where chrom is not null and start_pos >= 0 and signalvalue >= 0 and not isnan(signalvalue) and not isinf(signalvalue)"


def _steps(spark: SparkSession, d: str, where: str) -> DataFrame:
    rows = table(spark, d, "narrow_peak").where(usable("signalvalue") & F.expr("chrom is not null and start_pos >= 0")).where(where)
    at, v = (F.col("start_pos") + 1).cast("string"), F.col("signalvalue").cast("string")
    variable = F.concat(F.lit("variableStep chrom="), "chrom", F.lit(" span="), (F.col("rec_id") % 3 + 1).cast("string"), F.lit("\n"), at, F.lit(" "), v)
    fixed = F.concat(F.lit("fixedStep chrom="), "chrom", F.lit(" start="), at, F.lit(" step=10 span=2\n"), v, F.lit("\n-1.5"))
    return T.read_wiggle(spark, _file(F.when(F.col("rec_id") % 2 == 0, variable).otherwise(fixed), rows))


@query(f"""select chrom, start_pos, start_pos + rec_id % 3 + 1 end_pos, '+' strand, signalvalue "value" {_WIG} and rec_id % 2 = 0
    union all select chrom, start_pos, start_pos + 2, '+', signalvalue {_WIG} and rec_id % 2 <> 0 union all select chrom, start_pos + 10, start_pos + 12, '+', -1.5 {_WIG} and rec_id % 2 <> 0""")
def io_wiggle_steps(spark, d):
    return _steps(spark, d, "true")


@query(f"""select chrom, start_pos + unnest(range(rec_id % 3 + 1)) pos, signalvalue "value" {_WIG} and rec_id % 2 = 0""")
def io_wiggle_positions(spark, d):
    return T.by_position(_steps(spark, d, "rec_id % 2 = 0"))


@query(f"""select chrom, start_pos, start_pos + 5 end_pos, '-' strand, signalvalue "value" {_WIG}""")
def io_wiggle_bed(spark, d):
    rows = table(spark, d, "narrow_peak").where(usable("signalvalue") & F.expr("chrom is not null and start_pos >= 0"))
    return T.read_wiggle(spark, _file(F.concat_ws("\t", "chrom", "start_pos", F.col("start_pos") + 5, "signalvalue", F.lit("x"), F.lit("-")), rows))


_WHOLE = "src is not null and start_pos is not null and aln_size is not null and strand is not null and src_size is not null"
_KNOWN = "left_status is not null and right_status is not null and text is not null"


@query(f"""select cast(block_id as double) score, src, start_pos, aln_size, strand, src_size, text, case when {_KNOWN} then left_status end left_status,
    case when {_KNOWN} then coalesce(left_len, 0) end left_len, case when {_KNOWN} then right_status end right_status, case when {_KNOWN} then coalesce(right_len, 0) end right_len,
    case when text is null then empty_status end empty_status
    from maf_component where {_WHOLE} and (length(text) > 0 or text is null and empty_status is not null)""")
def io_maf(spark, d):
    rows = table(spark, d, "maf_component").where(f"{_WHOLE} and (length(text) > 0 or text is null and empty_status is not null)").withColumn("score", F.col("block_id").cast("double"))
    return X.read_maf(spark, _file(K.maf_blocks(rows).select("value"))).drop("block_id", "comp_no", "quality")


@query(f"""with c as (select * from maf_component where {_WHOLE} and length(text) > 0 and comp_no < 2 and strand in ('+', '-')),
    k as (select block_id from c group by block_id having count(*) = 2 and count(distinct comp_no) = 2), t as (select c.* from c join k using (block_id)),
    f as (select block_id, strand = '-' turn from t where comp_no = 0)
    select comp_no, src, case when turn then src_size - start_pos - aln_size else start_pos end start_pos, aln_size,
      case when turn then case strand when '+' then '-' else '+' end else strand end strand, case when turn then reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) else text end text
    from t join f using (block_id)""")
def io_axt(spark, d):
    c = table(spark, d, "maf_component").where(f"{_WHOLE} and length(text) > 0 and comp_no < 2 and strand in ('+', '-')")
    k = c.groupBy("block_id").agg(F.count("*").alias("n"), F.count_distinct("comp_no").alias("m")).where("n = 2 and m = 2").select("block_id")
    return X.read_axt(spark, _file(K.axt_blocks(c.join(k, "block_id", "left_semi")).select("value"))).drop("block_id", "score", "src_size")


@query("select cast(comp_id as varchar) name, 'comp_id ' || comp_id description, regexp_replace(text, '\\s', '', 'g') text from maf_component where length(text) > 0")
def io_fasta(spark, d):
    rows = table(spark, d, "maf_component").where("length(text) > 0").select(F.concat(F.col("comp_id").cast("string"), F.lit(" > "), "comp_id").alias("head"), "text")
    got = Q_.read_fasta(spark, _file(K.fasta_records(rows, "head", "text", 70)))
    return got.select("name", F.concat(F.lit("comp_id "), F.substring_index("description", " > ", -1)).alias("description"), "text")


@query("""select cast(rec_id as varchar) chain_id, chrom t_name, start_pos t_start, end_pos t_end, (end_pos - start_pos) // 2 * 2 q_end,
    [(end_pos - start_pos) // 2, (end_pos - start_pos) // 2] sizes, [(end_pos - start_pos) % 2, 0] dt from narrow_peak where chrom is not null and end_pos - start_pos > 1""")
def io_chains(spark, d):
    rows = table(spark, d, "narrow_peak").where("chrom is not null and end_pos - start_pos > 1").withColumn("h", F.expr("(end_pos - start_pos) div 2"))
    text = F.format_string("chain 1 %s 999999999999 + %d %d q 1000000000 + 0 %d %d\n%d %d 0\n%d\n", "chrom", "start_pos", "end_pos", F.col("h") * 2, "rec_id", "h", F.col("end_pos") - F.col("start_pos") - F.col("h") * 2, "h")
    return X.read_chains(spark, _file(text, rows)).select("chain_id", "t_name", "t_start", "t_end", "q_end", "sizes", "dt")


_EPO = "from narrow_peak where chrom is not null and start_pos >= 0 and start_pos < end_pos"


@query(f"""select 'sp' species, cast(rec_id as varchar) gabid, chrom, start_pos + 1 start_pos, end_pos, '-' strand,
    end_pos - start_pos || 'M3D' cigar {_EPO} and rec_id % 3 <> 0 and end_pos - start_pos > 1""")
def io_epo(spark, d):
    rows = table(spark, d, "narrow_peak").where("chrom is not null and start_pos >= 0 and end_pos - start_pos > 1")
    off = F.when(F.col("rec_id") % 3 == 0, 1).otherwise(0)  # a span that isn't the sum of the matches
    text = F.format_string("sp %d %s %d %d -1 %dM3D (a:1)", "rec_id", "chrom", F.col("start_pos") + 1, "end_pos", F.col("end_pos") - F.col("start_pos") + off)
    return X.read_epo(spark, _file(text, rows))


@query(f"""select rec_id, start_pos + rec_id % 4 + 1 s1, start_pos + rec_id % 4 + 6 e1, start_pos + rec_id % 4 + 7 s2, start_pos + rec_id % 4 + 8 e2 {_EPO}""")
def cigar_matches(spark, d):
    rows = table(spark, d, "narrow_peak").where("chrom is not null and start_pos >= 0 and start_pos < end_pos")
    cigar = F.concat((F.col("rec_id") % 4 + 1).cast("string"), F.lit("D5MDM"))
    m = rows.select("rec_id", X.cigar_matches(cigar, F.col("start_pos")).alias("m"))
    return m.select("rec_id", F.col("m")[0]["s"].alias("s1"), F.col("m")[0]["e"].alias("e1"), F.col("m")[1]["s"].alias("s2"), F.col("m")[1]["e"].alias("e2"))


@query(f"""select chrom, 'peak' feature, start_pos, end_pos, coalesce(strand, '.') strand, 'g' || rec_id gene {_EPO}""")
def io_features(spark, d):
    rows = table(spark, d, "narrow_peak").where("chrom is not null and start_pos >= 0 and start_pos < end_pos")
    cells = ["chrom", F.lit("own"), F.lit("peak"), F.col("start_pos") + 1, "end_pos", F.lit("."), F.coalesce("strand", F.lit(".")), F.lit("."), F.concat(F.lit('gene_id "g'), "rec_id", F.lit('"; x "1"'))]
    return X.read_features(spark, _file(F.concat_ws("\t", *cells), rows))


@query("""select name accession, 'm' || length motif_id, 'a motif' name, 'of ' || name description, [[length % 7, 1.0, 2.5, 0.0], [0.0, length % 5, 0.0, 1.0]] counts
    from chrom_size where name is not null and length is not null""")
def io_transfac(spark, d):
    sizes = table(spark, d, "chrom_size").where("name is not null and length is not null")
    row = lambda *v: F.array(*[x.cast("double") for x in v])
    counts = F.array(row(F.col("length") % 7, F.lit(1), F.lit(2.5), F.lit(0)), row(F.lit(0), F.col("length") % 5, F.lit(0), F.lit(1)))
    motifs = sizes.select(
        F.col("name").alias("accession"), F.concat(F.lit("m"), F.col("length").cast("string")).alias("motif_id"), F.concat(F.lit("of "), "name").alias("description"),
        F.lit("a motif").alias("name"), counts.alias("counts"),
    )
    return Q_.read_transfac(spark, _file(K.transfac_records(motifs))).select("accession", "motif_id", "name", "description", "counts")


@query("select chrom, start_pos, end_pos, nullif(id, '.') name, cast(score as double) score from narrow_peak where chrom is not null and start_pos >= 0 and end_pos >= start_pos")
def io_bed(spark, d):
    rows = table(spark, d, "narrow_peak").where("chrom is not null and start_pos >= 0 and end_pos >= start_pos")
    return T.read_bed(spark, _file(T.render([F.col(c) for c in ("chrom", "start_pos", "end_pos", "id", "score")]), rows))


@query(f"""select 'q' chrom, 1000 - 500 start_pos, 1000 - 500 + (end_pos - start_pos) // 2 * 2 end_pos, cast(rec_id as varchar) name, 1.0 score, '-' strand {_EPO} and end_pos - start_pos between 2 and 999
    union all select chrom, start_pos, end_pos, cast(rec_id as varchar), 1.0, '+' {_EPO} and end_pos - start_pos between 2 and 999""")
def chain_sides(spark, d):
    rows = table(spark, d, "narrow_peak").where("chrom is not null and start_pos >= 0 and end_pos - start_pos between 2 and 999").withColumn("h", F.expr("(end_pos - start_pos) div 2"))
    at = F.lit(500) - F.col("h") * 2
    text = F.format_string("chain 1 %s 999999999999 + %d %d q 1000 - %d %d %d\n%d %d 0\n%d\n", "chrom", "start_pos", "end_pos", at, at + F.col("h") * 2, "rec_id", "h", F.col("end_pos") - F.col("start_pos") - F.col("h") * 2, "h")
    chains = X.read_chains(spark, _file(text, rows))
    return C.chain_side(chains, "q", forward=True).unionByName(C.chain_side(chains, "t"))


@query("select * from (values (0, null, null, null), (1, 0, 'x', 0.5), (2, 1, 'a', 1.0), (3, 1, 'it''s b', 2.25), (4, 0, 'c', 3.0)) t(id, parent, label, length)")
def newick_tree(spark, d):
    return Q_.newick_edges(spark, "((a:1,'it''s b':2.25)x:0.5,c:3);")


@query("""with b as (select line_id, chrom, start_pos, end_pos from (%s) q), s as (select line_id, chrom, min(start_pos) a, max(end_pos) z, count(*) n from b group by 1, 2)
    select s.chrom || chr(9) || a || chr(9) || z || chr(9) || line_id || chr(9) || '1000' || chr(9) || '+' || chr(9) || a || chr(9) || z || chr(9) || '0,0,0' || chr(9) || n || chr(9)
      || (select string_agg(cast(end_pos - start_pos as varchar), ',' order by start_pos, end_pos) from b where b.line_id = s.line_id and b.chrom = s.chrom) || chr(9)
      || (select string_agg(cast(start_pos - a as varchar), ',' order by start_pos, end_pos) from b where b.line_id = s.line_id and b.chrom = s.chrom) as "value" from s""")
def bed12_lines(spark, d):
    return K.bed12(G.exons(gene_records(table(spark, d, "gene_line"))).select("line_id", "chrom", "start_pos", "end_pos"), "line_id")


def _finish() -> None:
    from strandlake.plans import signal_queries

    SQL["bed12_lines"] = SQL["bed12_lines"] % signal_queries.SQL["exons"]


_finish()
QUERIES = Q
