"""Queries on plain tables: filters, columns, duplicates, recoding, grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import probability as P
from strandlake.functions.sequence import finite
from strandlake.operators import stats as Z
from strandlake.operators import tables as B
from strandlake.operators.chunking import running_totals
from strandlake.plans.tables import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ev(spark, d):
    return table(spark, d, "events")


def _r(df, n: int = 6, *names: str):
    return df.withColumns({c: F.round(c, n) for c in names})


@query("select l_orderkey, l_quantity from lineitem where l_quantity > 30 and l_discount < 0.05")
def table_filter(spark, d):
    return table(spark, d, "lineitem").filter(F.expr("l_quantity > 30 and l_discount < 0.05")).select("l_orderkey", "l_quantity")


@query("select o_orderkey, o_orderpriority from orders")
def table_cut(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority")


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) net from lineitem")
def table_add_column(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.expr("l_extendedprice * (1 - l_discount)"), 4).alias("net"))


@query("select o_orderkey, case o_orderstatus when 'F' then 'done' when 'O' then 'open' else o_orderstatus end status from orders")
def recode(spark, d):
    return table(spark, d, "orders").replace({"F": "done", "O": "open"}, subset=["o_orderstatus"]).select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query("select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def unique_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("with k as (select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1) select l_orderkey, l_linenumber from k, unnest(range(n - 1)) t(i)")
def duplicate_rows(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")
    return n.select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n") - 1)).alias("i")).drop("i")


@query("select l_orderkey, l_linenumber from lineitem group by 1, 2 having count(*) = 1")
def nonrepeats(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n = 1").drop("n")


@query("select event_type, user_id, round(avg(value), 6) mean_value, round(stddev_samp(value) / sqrt(count(*)), 6) std_error, count(*) n from events group by 1, 2")
def collapse(spark, d):
    v = F.col("value")
    g = _ev(spark, d).groupBy("event_type", "user_id").agg(F.avg(v).alias("mean_value"), (F.stddev_samp(v) / F.sqrt(F.count("*"))).alias("std_error"), F.count("*").alias("n"))
    return _r(g, 6, "mean_value", "std_error")


_M = "select event_type, count(value) n, avg(value) m, var_pop(value) vn from events where value is not null group by 1"


@query(f"""with m as ({_M}), c as (select e.event_type, avg(pow(value - m, 3)) m3, avg(pow(value - m, 4)) m4 from events e join m using (event_type) where value is not null group by 1)
    select event_type, any_value(n) n, round(any_value(m), 6) mean, round(exp(avg(ln(case when value > 0 then value end))), 6) geo_mean,
    round(count(case when value > 0 then 1 end) / sum(1 / case when value > 0 then value end), 6) harm_mean, round(any_value(vn), 6) var_n,
    round(var_samp(value), 6) var_n1, round(any_value(m3) / pow(any_value(vn), 1.5), 6) skew, round(any_value(m4) / pow(any_value(vn), 2), 6) kurt,
    round(100 * stddev_pop(value) / avg(value), 6) variation from events join m using (event_type) join c using (event_type) where value is not null group by 1""")
def describe(spark, d):
    keep = ["mean", "geo_mean", "harm_mean", "var_n", "var_n1", "skew", "kurt", "variation"]
    return _r(Z.describe(_ev(spark, d), ["event_type"], "value"), 6, *keep).select("event_type", "n", *keep)


_H = """with l as (select event_type, min(value) lo, max(value) hi, count(value) total from events where value is not null group by 1),
s as (select event_type, total, (hi - lo + (hi - lo) / {n} + 1) / {n} bs, lo - (hi - lo + (hi - lo) / {n} + 1) / {n} / 2 ll from l),
c as (select s.event_type, cast(floor((value - ll) / bs) as int) bin, count(*) k from events join s using (event_type) where value is not null group by 1, 2),
h as (select s.*, cast(b as int) bin, coalesce(k, 0) n, sum(coalesce(k, 0)) over (partition by s.event_type order by b) cum from s cross join range({n}) t(b) left join c on c.event_type = s.event_type and c.bin = b)"""


@query(_H.format(n=10) + " select event_type, bin, n, cast(cum as bigint) cum, round(n / total, 6) rel, round(ll, 6) low_limit, round(bs, 6) bin_size, total from h")
def histogram(spark, d):
    return _r(Z.histogram(_ev(spark, d), ["event_type"], "value"), 6, "rel", "low_limit", "bin_size")


@query(_H.format(n=1000) + " select event_type, round(ll + bs * (bin + (total * 0.5 - cum + n) / n), 4) score from h where cum >= total * 0.5 and cum - n < total * 0.5")
def histogram_median(spark, d):
    return _r(Z.score_at_percentile(_ev(spark, d), ["event_type"], "value", 0.5, 1000), 4, "score")


@query("select event_type, round(value, 0) v, count(*) n from events where value is not null group by 1, 2")
def item_freq(spark, d):
    return Z.item_freq(_ev(spark, d).withColumn("v", F.round("value", 0)), ["event_type"], "v")


@query("""with f as (select event_type, round(value, 0) v, count(*) n from events where value is not null group by 1, 2)
    select event_type, v, n from f qualify n = max(n) over (partition by event_type)""")
def modes(spark, d):
    return Z.modes(_ev(spark, d).withColumn("v", F.round("value", 0)), ["event_type"], "v")


@query("""select event_id, round((value - avg(value) over w) / stddev_pop(value) over w, 6) z from events window w as (partition by event_type)""")
def zscores(spark, d):
    return _r(Z.z_scores(_ev(spark, d), ["event_type"], "value"), 6, "z").select("event_id", "z")


_RANK = "rank() over (partition by {k} order by {x}) + (count(*) over (partition by {k}, {x}) - 1) / 2"


@query(f"select event_id, {_RANK.format(k='event_type', x='value')} \"rank\" from events where value is not null")
def ranks(spark, d):
    return Z.ranks(_ev(spark, d), ["event_type"], "value").select("event_id", "rank")


@query("""with o as (select *, row_number() over (partition by event_type order by value, event_id) k, count(*) over (partition by event_type) n from events where value is not null)
    select event_id from o where k > floor(n * 0.1) and k <= n - floor(n * 0.1)""")
def trim_both(spark, d):
    return Z.trim(_ev(spark, d), ["event_type"], "value", ["event_id"], 0.1).select("event_id")


@query("select l_returnflag, count(*) n, round(corr(l_quantity, l_extendedprice), 6) r from lineitem group by 1")
def pearson(spark, d):
    return _r(Z.pearson(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 6, "r").select("l_returnflag", "n", "r")


@query(f"""with a as (select *, {_RANK.format(k='l_returnflag', x='l_quantity')} rx, {_RANK.format(k='l_returnflag', x='l_discount')} ry from lineitem)
    select l_returnflag, count(*) n, round(1 - 6 * sum((rx - ry) * (rx - ry)) / (count(*)::double * (count(*)::double * count(*) - 1)), 6) rho from a group by 1""")
def spearman(spark, d):
    return _r(Z.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount"), 6, "rho")


@query("""select l_returnflag, count(*) n, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 4) intercept,
    round(corr(l_extendedprice, l_quantity), 6) r from lineitem group by 1""")
def linregress(spark, d):
    out = Z.linregress(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").drop("std_err")
    return _r(_r(out, 4, "slope", "intercept"), 6, "r")


_CLICK = "event_type = 'click'"


@query(f"""with s as (select count(*) filter ({_CLICK}) n1, count(*) filter (not ({_CLICK})) n2, avg(value) filter ({_CLICK}) m1, avg(value) filter (not ({_CLICK})) m2,
    var_samp(value) filter ({_CLICK}) v1, var_samp(value) filter (not ({_CLICK})) v2 from events where value is not null)
    select n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) t from s""")
def ttest_ind(spark, d):
    return _r(Z.ttest_ind(_ev(spark, d), [], "value", F.expr(_CLICK)), 6, "t").drop("p")


@query("""with g as (select event_type, count(*) n, sum(value) s, var_pop(value) v from events where value is not null group by 1),
    a as (select count(*) k, sum(n) n, sum(s) s, sum(s * s / n) b, sum(v * n) w from g) select k, cast(n as bigint) n, round(((b - s * s / n) / (k - 1)) / (w / (n - k)), 6) f from a""")
def anova(spark, d):
    return _r(Z.anova(_ev(spark, d), [], "event_type", "value"), 6, "f").drop("p")


_RK = "with r as (select *, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2 rk, count(*) over (partition by value) tt from events where value is not null)"


@query(_RK + f""", a as (select count(*) filter ({_CLICK})::double n1, count(*) filter (not ({_CLICK}))::double n2, sum(rk) filter ({_CLICK}) r1 from r),
    u as (select n1, n2, n1 * n2 + n1 * (n1 + 1) / 2 - r1 u1 from a) select n1::bigint n1, n2::bigint n2, round(least(u1, n1 * n2 - u1), 2) u from u""")
def mannwhitney(spark, d):
    return _r(Z.mann_whitney(_ev(spark, d), [], "value", F.expr(_CLICK)), 2, "u").select("n1", "n2", "u")


@query(_RK + """, g as (select event_type, count(*)::double n, sum(rk) s, sum(tt * tt - 1.0) t from r group by 1),
    a as (select count(*) k, sum(n) n, sum(s * s / n) q, sum(t) t from g) select k, n::bigint n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 4) h from a""")
def kruskal(spark, d):
    return _r(Z.kruskal(_ev(spark, d), [], "event_type", "value"), 4, "h").drop("p")


@query(f"""with c as (select value, count(*) filter ({_CLICK}) c1, count(*) filter (not ({_CLICK})) c2 from events where value is not null group by 1),
    r as (select sum(c1) over (order by value) / sum(c1) over () a, sum(c2) over (order by value) / sum(c2) over () b from c) select round(max(abs(a - b)), 6) d from r""")
def ks_2samp(spark, d):
    return _r(Z.ks_2samp(_ev(spark, d), [], "value", F.expr(_CLICK)), 6, "d").select("d")


@query("""with c as (select event_type, count(*) n from events group by 1), m as (select avg(n) e from c) select count(*) k, round(sum((n - e) * (n - e) / e), 6) chi2 from c, m""")
def chisquare(spark, d):
    return _r(Z.chisquare(_ev(spark, d).groupBy("event_type").agg(F.count("*").alias("n")), [], "n"), 6, "chi2").drop("p")


@query("""select event_type, count(*) filter (value between 1 and 20) n, round(avg(value) filter (value between 1 and 20), 6) t_mean,
    round(var_samp(value) filter (value between 1 and 20), 6) t_var from events where value is not null group by 1""")
def trimmed_stats(spark, d):
    return _r(Z.trimmed(_ev(spark, d), ["event_type"], "value", 1, 20), 6, "t_mean", "t_var").select("event_type", "n", "t_mean", "t_var")


@query(f"""with m as ({_M}), c as (select e.event_type, count(value)::double n, avg(pow(value - m, 3)) / pow(var_pop(value), 1.5) b, avg(pow(value - m, 4)) / pow(var_pop(value), 2) k
      from events e join m using (event_type) where value is not null group by 1),
    s as (select *, b * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) be from c where n > 8),
    w as (select *, sqrt(2 * (be - 1)) - 1 w2 from s), z as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) zs,
      (k - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) r from w),
    a as (select *, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) a from z), i as (select *, (1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))) q from a),
    t as (select *, (1 - 2 / (9 * a) - sign(q) * pow(abs(q), 1.0 / 3)) / sqrt(2 / (9 * a)) zk from i)
    select event_type, cast(n as bigint) n, round(zs, 6) z_skew, round(zk, 6) z_kurt, round(zs * zs + zk * zk, 6) chi2, round(exp(-(zs * zs + zk * zk) / 2), 6) p from t""")
def normality(spark, d):
    return _r(Z.normality(_ev(spark, d), ["event_type"], "value"), 6, "z_skew", "z_kurt", "chi2", "p")


@query("""with k(a, b, cov, corr) as (select 'l_quantity', 'l_discount', covar_samp(l_quantity, l_discount), corr(l_quantity, l_discount) from lineitem union all
    select 'l_discount', 'l_quantity', covar_samp(l_discount, l_quantity), corr(l_discount, l_quantity) from lineitem union all
    select 'l_quantity', 'l_quantity', covar_samp(l_quantity, l_quantity), corr(l_quantity, l_quantity) from lineitem union all
    select 'l_discount', 'l_discount', covar_samp(l_discount, l_discount), corr(l_discount, l_discount) from lineitem) select a, b, round(cov, 6) cov, round(corr, 6) corr from k""")
def covariance(spark, d):
    return _r(Z.covariance(table(spark, d, "lineitem"), [], ["l_quantity", "l_discount"]), 6, "cov", "corr")


@query("select time_bucket(interval 1 hour, ts) w_start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def tumbling_windows(spark, d):
    g = _ev(spark, d).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("w_start"), "event_type", "n", "total")


@query("""with o as (select *, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end nw from events window w as (partition by user_id order by ts)),
    s as (select *, sum(nw) over (partition by user_id order by ts rows unbounded preceding) k from o)
    select user_id, min(ts) s_start, max(ts) + interval 30 minute s_end, count(*) n from s group by user_id, k""")
def session_windows(spark, d):
    g = _ev(spark, d).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("s_start"), F.col("session_window.end").cast("timestamp_ntz").alias("s_end"), "n")


@query("select event_type, count(value) n, round((avg(value) - 10) / (stddev_samp(value) / sqrt(count(value))), 6) t from events where value is not null group by 1")
def ttest_1samp(spark, d):
    return _r(Z.ttest_1samp(_ev(spark, d), ["event_type"], "value", 10.0), 6, "t").select("event_type", "n", "t")


@query("""select l_returnflag, count(*) n, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) t from
    (select l_returnflag, l_discount::double l_discount, l_tax::double l_tax from lineitem) group by 1""")
def ttest_rel(spark, d):
    return _r(Z.ttest_rel(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_tax"), 6, "t").select("l_returnflag", "n", "t")


_SIGNED = f"""with d0 as (select l_returnflag k, l_quantity::double - l_linenumber * 9 d from lineitem), d1 as (select *, abs(d) a from d0 where d <> 0),
    r as (select *, {_RANK.format(k='k', x='a')} rk from d1)"""


@query(_SIGNED + """, w as (select k, count(*)::double n, least(coalesce(sum(rk) filter (d > 0), 0), coalesce(sum(rk) filter (d < 0), 0)) w from r group by 1)
    select k l_returnflag, cast(n as bigint) n, w, round(abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) z from w""")
def wilcoxon(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("q"), (F.col("l_linenumber") * 9).cast("double").alias("m"))
    return _r(Z.wilcoxon(rows, ["l_returnflag"], "q", "m"), 6, "z").select("l_returnflag", "n", "w", "z")


@query(_RK + f""", a as (select count(*) filter ({_CLICK})::double n1, count(*) filter (not ({_CLICK}))::double n2, sum(rk) filter ({_CLICK}) s from r)
    select cast(n1 as bigint) n1, cast(n2 as bigint) n2, round((s - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 6) z from a""")
def rank_sums(spark, d):
    return _r(Z.rank_sums(_ev(spark, d), [], "value", F.col("event_type") == "click"), 6, "z").select("n1", "n2", "z")


_BLOCKS = "select o_custkey, o_orderpriority, avg(o_totalprice)::double v from orders group by 1, 2"


@query(f"""with v as ({_BLOCKS}), f as (select * from v where o_custkey in (select o_custkey from v group by 1 having count(*) = 5)),
    r as (select *, {_RANK.format(k='o_custkey', x='v')} rk from f), g as (select o_orderpriority, sum(rk) s, count(*)::double n from r group by 1),
    a as (select count(*)::double k, max(n) n, sum(s * s) q from g)
    select cast(k as bigint) k, cast(n as bigint) n, round(12 / (k * n * (k + 1)) * q - 3 * n * (k + 1), 6) chi2 from a""")
def friedman(spark, d):
    v = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.avg("o_totalprice").cast("double").alias("v"))
    whole = v.groupBy("o_custkey").agg(F.count("*").alias("k")).where("k = 5").select("o_custkey")
    return _r(Z.friedman(v.join(whole, "o_custkey", "left_semi"), "o_custkey", "o_orderpriority", "v"), 6, "chi2").select("k", "n", "chi2")


@query("""with s as (select event_type, count(value)::double n, var_samp(value) v, avg(value) m from events where value is not null group by 1)
    select event_id, round(((n - 1.5) * n * (value - m) * (value - m) - 0.5 * v * (n - 1)) / ((n - 1) * (n - 2)), 5) r from events join s using (event_type) where value is not null and n > 2""")
def obrien(spark, d):
    return _r(Z.obrien(_ev(spark, d), "event_type", "value"), 5, "r").where("r is not null").select("event_id", "r")


@query(_H.format(n=10) + " select event_type, round((cum - n + ((12.5 - ll) / bs - bin) * n) / total * 100, 5) pct from h where 12.5 >= ll + bs * bin and 12.5 < ll + bs * (bin + 1)")
def percentile_of_score(spark, d):
    return _r(Z.percentile_of_score(_ev(spark, d), ["event_type"], "value", 12.5), 5, "pct")


@query(f"select round(corr(case when {_CLICK} then 1.0 else 0.0 end, value), 6) r, count(*) n from events where value is not null")
def point_biserial(spark, d):
    rows = _ev(spark, d).withColumn("is_click", (F.col("event_type") == "click").cast("int"))
    return _r(Z.point_biserial(rows, [], "is_click", "value"), 6, "r").select("n", "r")


@query("select event_type, round(sum(value), 3) total, round(sum(value * value), 3) ss, round(sum(value) * sum(value), 1) square_of_sum from events where value is not null group by 1")
def value_sums(spark, d):
    out = Z.describe(_ev(spark, d), ["event_type"], "value").select("event_type", "total", "ss", "square_of_sum")
    return _r(_r(out, 3, "total", "ss"), 1, "square_of_sum")


@query("""with v as (select event_id, abs(value) x from events where value is not null) select event_id, round(exp(-x / 2), 6) chi2_p, round(1 - 2 / pi() * atan(x), 6) t_p,
    round(pow(1 + x / 5, -5.0), 6) f_p from v""")
def tail_probabilities(spark, d):
    """Tails that have a closed form: chi-square with 2, t with 1, F with 2 and 10 degrees of freedom."""
    x = F.abs("value")
    one = lambda n: F.lit(float(n))
    rows = _ev(spark, d).where("value is not null").withColumn("x", x)
    out = rows.select("event_id", P.chi2_p("x", one(2)).alias("chi2_p"), P.t_p("x", one(1)).alias("t_p"), P.f_p("x", one(2), one(10)).alias("f_p"))
    return _r(out, 6, "chi2_p", "t_p", "f_p")


@query("""select rec_id, signalvalue is not null and not isnan(signalvalue) and not isinf(signalvalue) finite, coalesce(isnan(signalvalue), false) nan,
    coalesce(isinf(signalvalue), false) inf from narrow_peak""")
def number_kinds(spark, d):
    v = F.col("signalvalue")
    return table(spark, d, "narrow_peak").select(
        "rec_id", F.coalesce(finite(v), F.lit(False)).alias("finite"), F.coalesce(F.isnan(v), F.lit(False)).alias("nan"), F.coalesce(F.abs(v) == float("inf"), F.lit(False)).alias("inf")
    )


@query("select o_orderkey, row_number() over (order by o_orderdate, o_totalprice desc, o_orderkey) row_no from orders")
def sort_columns(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return running_totals(rows, [], [F.col("o_orderdate"), F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", "row_no")


@query("select l_orderkey, l_linenumber, 'all' rule from lineitem where l_returnflag = 'R' and l_linenumber = 1 union all select l_orderkey, l_linenumber, 'any' from lineitem where l_returnflag = 'R' or l_linenumber = 1")
def rows_that_match(spark, d):
    rows, wanted = table(spark, d, "lineitem"), {"l_returnflag": "R", "l_linenumber": 1}
    both = B.where_all(rows, wanted).withColumn("rule", F.lit("all")).unionByName(B.where_any(rows, wanted).withColumn("rule", F.lit("any")))
    return both.select("l_orderkey", "l_linenumber", "rule")


@query("select user_id, round(max(value) - min(value), 6) spread, cast(count(value) as double) n from events where value is not null group by user_id")
def collapse_own_function(spark, d):
    functions = {"spread": ("value", lambda v: v.max() - v.min()), "n": ("value", lambda v: v.count())}
    return _r(B.collapse(_ev(spark, d).where("value is not null"), ["user_id"], functions), 6, "spread")


QUERIES = Q
