"""Every panel query by name, with its SQL for DuckDB."""

from __future__ import annotations

import random
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalpanel.functions.guards import safe_div
from causalpanel.operators import asof, calendar, compare, model, profile, quality, reporting, resample, selection, temporal
from causalpanel.operators import prices as px
from causalpanel.operators import rank as rk
from causalpanel.plans import expr, folds, search
from causalpanel.session import table
from causalpanel.sources import io, panels
from causalpanel.sources.panels import ARM_SQL, PRICES_SQL, REPORTS_SQL, SPARSE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FEATURES = ["f_qty", "f_rev", "f_disc", "f_n", "f_const"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def kept(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return kept


def rounded(d: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return d.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})  # no negative zero


# --- rows, columns, joins


@query("""select o_orderkey, o_custkey, o_orderdate::date as o_orderdate from orders
where o_orderstatus in ('F', 'O') and o_custkey is not null and o_orderpriority <> '5-LOW' and o_orderdate >= date '1997-01-01'""")
def universe_filter(spark, sf):
    d = table(spark, sf, "orders")
    rule = quality.universe({"o_orderstatus": ["F", "O"]}, ["o_custkey"], {"o_orderpriority": ["5-LOW"]}, ("o_orderdate", date(1997, 1, 1)))
    return d.where(rule).select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"))


@query("""select s_suppkey, s_name, n_name, r_name, count(*) as lines, round(sum(l_quantity)::double, 4) as qty
from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey
group by all""")
def star_join(spark, sf):
    d = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity").cast("double"), 4).alias("qty"))
    d = d.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    d = d.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return d.select("s_suppkey", "s_name", "n_name", "r_name", "lines", "qty")


@query("""select c_custkey, c_name, c_nationkey, n_name, n_regionkey from customer join nation on c_nationkey = n_nationkey""")
def overlap_projection(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey"), F.col("c_nationkey").alias("key"))
    right = table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), "n_name", "n_regionkey", F.col("n_name").alias("c_name"))
    return left.join(quality.without_overlap(left, right, ["key"]), "key").drop("key")


@query(f"""with {REPORTS_SQL}, {PRICES_SQL}
select r.entity, r.period_end, round(case when r.period_end - p.p_date <= 14 then p.p_price end, 6) as price
from reports r asof left join prices p on r.entity = p.entity and r.period_end >= p.p_date""")
def asof_carry(spark, sf):
    d = asof.asof_carry(panels.reports(spark, sf).select("entity", "period_end"), panels.prices(spark, sf), "p_price", "entity", "period_end", "entity", "p_date", 14, "price")
    return rounded(d, "price")


@query(f"""with {REPORTS_SQL}, {PRICES_SQL}, s as (select entity, p_date from prices),
f as (select entity, period_end, f_qty from reports where f_qty is not null)
select s.entity, s.p_date, round(case when s.p_date - f.period_end <= 60 then f.f_qty end, 6) as f_qty
from s asof left join f on s.entity = f.entity and s.p_date >= f.period_end""")
def asof_carry_stale(spark, sf):
    keys = panels.prices(spark, sf).select("entity", "p_date")
    return rounded(asof.asof_carry(keys, panels.reports(spark, sf).select("entity", "period_end", "f_qty"), "f_qty", "entity", "p_date", "entity", "period_end", 60), "f_qty")


@query(f"""with {REPORTS_SQL}, {PRICES_SQL}
select r.entity, r.period_end, round(p.p_price * r.f_qty, 4) as size
from reports r asof join prices p on r.entity = p.entity and r.period_end >= p.p_date
where r.period_end - p.p_date <= 14 and p.p_price * r.f_qty > 1000000""")
def size_filter(spark, sf):
    d = asof.asof_carry(panels.reports(spark, sf).select("entity", "period_end", "f_qty"), panels.prices(spark, sf), "p_price", "entity", "period_end", "entity", "p_date", 14)
    return d.where(F.col("p_price") * F.col("f_qty") > 1_000_000).select("entity", "period_end", F.round(F.col("p_price") * F.col("f_qty"), 4).alias("size"))


AVAILABLE_SQL = f"""{REPORTS_SQL},
lags as (select *, src_date - period_end as lag from reports),
fb as (select coalesce(quantile_disc(lag, 0.9), 45)::int as days from lags where lag >= 0),
avail as (select lags.*, case when lag >= 0 then src_date else period_end + days end as available from lags, fb)"""


def _available(spark, sf):
    return asof.availability_date(panels.reports(spark, sf), "period_end", ["src_date"])


@query(f"with {AVAILABLE_SQL} select entity, period_end, available from avail")
def availability_date(spark, sf):
    return _available(spark, sf).select("entity", "period_end", "available")


@query(f"""with {REPORTS_SQL}, w as (
  select *, last_value(case when f_qty is not null then period_end end ignore nulls) over o as seen, last_value(f_qty ignore nulls) over o as v
  from reports window o as (partition by entity order by period_end rows between unbounded preceding and current row))
select entity, period_end, round(case when period_end - seen <= 183 then v end, 6) as f_qty from w""")
def causal_fill(spark, sf):
    d = asof.causal_fill(panels.reports(spark, sf).select("entity", "period_end", "f_qty"), ["f_qty"], "entity", "period_end")
    return rounded(d, "f_qty")


@query(f"""with {SPARSE_SQL}, {PRICES_SQL},
a as (select entity, min(month) a0, max(month) a1 from sparse group by 1), b as (select entity, min(p_date) b0, max(p_date) b1 from prices group by 1),
k as (select entity from a join b using (entity) where a0 <= b1 and b0 <= a1)
select 'left' as side, entity, count(*) as n from sparse semi join k using (entity) group by all
union all select 'right', entity, count(*) from prices semi join k using (entity) group by all""")
def align_overlap(spark, sf):
    a, b = asof.align(panels.sparse_months(spark, sf), panels.prices(spark, sf), "entity", "month", "p_date")
    one = lambda d, side: d.groupBy("entity").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "entity", "n")
    return one(a, "left").unionByName(one(b, "right"))


# --- prices and returns

ADJUSTED_SQL = f"""{PRICES_SQL},
adj as (
  select *, exp(sum(ln(coalesce(split_factor, 1.0))) over o) as split_cum,
         exp(sum(ln(case when dividend > 0 and coalesce(spinoff, 0) = 0 then 1 + dividend / p_price else 1.0 end)) over o) as dividend_cum
  from prices window o as (partition by entity order by p_date rows between unbounded preceding and current row)),
adjusted as (select *, p_price / split_cum * dividend_cum as adj_price from adj)"""
RETURNS_SQL = f"""{ADJUSTED_SQL},
mon as (select entity, cast(date_trunc('month', p_date) as date) as month, arg_max(adj_price, p_date) as adj_price from adjusted group by 1, 2),
pre as (select *, lag(adj_price) over o as p0, lag(year(month) * 12 + month(month)) over o as m0 from mon window o as (partition by entity order by month)),
ret as (
  select entity, month, adj_price, adj_price / p0 - 1 as monthly_return
  from pre where m0 = year(month) * 12 + month(month) - 1 and adj_price / p0 - 1 between -1 and 5),
sect as (select s_suppkey as entity, r_name as sector from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey),
rets as (select ret.*, sector from ret join sect using (entity)),
avgs as (select *, avg(monthly_return) over (partition by sector, month) as sector_return from rets),
lagged as (
  select *, lag(monthly_return) over o as prev_month_return, lag(sector_return) over o as prev_month_sector_return
  from avgs window o as (partition by entity order by month))"""


def _sectors(spark, sf):
    d = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return d.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("entity"), F.col("r_name").alias("sector"))


def _returns(spark, sf):
    months = px.month_end(px.adjust_prices(panels.prices(spark, sf)), ["entity"], "p_date", "adj_price")
    return px.monthly_returns(months, "adj_price", ["entity"])


def _lagged(spark, sf):
    return px.lag_predictors(_returns(spark, sf).join(_sectors(spark, sf), "entity"))


@query(f"""with {ADJUSTED_SQL} select entity, p_date, round(split_cum, 6) as split_cum, round(dividend_cum, 6) as dividend_cum, round(adj_price, 6) as adj_price from adjusted""")
def total_return_price(spark, sf):
    d = px.adjust_prices(panels.prices(spark, sf)).select("entity", "p_date", "split_cum", "dividend_cum", "adj_price")
    return rounded(d, "split_cum", "dividend_cum", "adj_price")


@query(f"""with {PRICES_SQL}, w as (
  select *, avg(p_price) over r as m, stddev_samp(p_price) over r as s, lag(p_price) over (partition by entity order by p_date) as b
  from prices window r as (partition by entity order by p_date rows between 30 preceding and current row))
select entity, p_date, coalesce(abs(p_price - m) > 2.5 * s, false) as is_outlier,
       round(case when abs(p_price - m) > 2.5 * s then case when m < 0 then b else m end else p_price end, 6) as smoothed from w""")
def outlier_flag(spark, sf):
    d = px.flag_outliers(panels.prices(spark, sf), "p_price", "entity", "p_date", 2.5)
    return rounded(d.select("entity", "p_date", "is_outlier", "smoothed"), "smoothed")


@query(f"with {RETURNS_SQL} select entity, month, round(monthly_return, 6) as monthly_return from ret")
def monthly_returns(spark, sf):
    return rounded(_returns(spark, sf).select("entity", "month", "monthly_return"), "monthly_return")


@query(f"""with {SPARSE_SQL}, w as (
  select *, lag(amount) over o as a0, lag(year(month) * 12 + month(month)) over o as m0 from sparse window o as (partition by entity order by month))
select entity, month, round(amount / a0 - 1, 6) as change from w where m0 = year(month) * 12 + month(month) - 1 and amount / a0 - 1 between -1 and 5""")
def gap_guard(spark, sf):
    d = px.monthly_returns(panels.sparse_months(spark, sf), "amount", ["entity"], name="change")
    return rounded(d.select("entity", "month", "change"), "change")


@query(f"""with {RETURNS_SQL} select entity, month, round(prev_month_return, 6) as prev_month_return, round(prev_month_sector_return, 6) as prev_month_sector_return from lagged""")
def return_lags(spark, sf):
    return rounded(_lagged(spark, sf).select("entity", "month", "prev_month_return", "prev_month_sector_return"), "prev_month_return", "prev_month_sector_return")


@query(f"with {RETURNS_SQL} select sector, month, round(avg(monthly_return), 6) as industry_return from rets group by all")
def industry_return(spark, sf):
    return rounded(px.industry_returns(_returns(spark, sf).join(_sectors(spark, sf), "entity")), "industry_return")


# --- calendar

EXPANDED_SQL = f"""{AVAILABLE_SQL}, {RETURNS_SQL},
nx as (select *, lead(available) over (partition by entity order by period_end) as nxt from avail),
rng as (
  select *, cast(date_trunc('month', available) as date) + interval 1 month as f,
         coalesce(date_trunc('month', nxt) + interval 1 month - interval 1 day, (select last_day(max(month)) from ret)) as t from nx),
ex as (
  select *, cast(unnest(generate_series(f::timestamp, t::timestamp, interval 1 month)) as date) as target_date from rng where f <= t),
expanded as (
  select * from ex qualify row_number() over (partition by entity, target_date order by period_end desc) = 1),
panel as (
  select e.entity, e.sector, e.period_end, e.target_date, f_qty, f_rev, f_disc, f_n, f_const, monthly_return, prev_month_return, prev_month_sector_return
  from expanded e join lagged l on e.entity = l.entity and e.target_date = l.month where monthly_return is not null)"""


def _expanded(spark, sf):
    last = _returns(spark, sf).agg(F.max("month")).scalar()
    return calendar.expand_reports(_available(spark, sf), "available", "period_end", last)


def _panel(spark, sf):
    d = calendar.join_panel(_expanded(spark, sf), _lagged(spark, sf))
    return d.select("entity", "sector", "period_end", "target_date", *FEATURES, "monthly_return", "prev_month_return", "prev_month_sector_return")


@query(f"with {EXPANDED_SQL} select entity, target_date, period_end, available from expanded")
def report_expand(spark, sf):
    return _expanded(spark, sf).select("entity", "target_date", "period_end", "available")


@query(f"""with {EXPANDED_SQL} select entity, target_date, period_end, sector, round(f_rev, 4) as f_rev, round(monthly_return, 6) as monthly_return,
round(prev_month_return, 6) as prev_month_return from panel""")
def panel_join(spark, sf):
    d = _panel(spark, sf).select("entity", "target_date", "period_end", "sector", F.round("f_rev", 4).alias("f_rev"), "monthly_return", "prev_month_return")
    return rounded(d, "monthly_return", "prev_month_return")


# --- temporal operators and expressions

SAFE_SQL = "(case when abs({0}) < 1e-6 then case when {0} < 0 then -1e-6 else 1e-6 end else {0} end)"


@query(f"""with {REPORTS_SQL}, w as (
  select *, lag(f_rev, 1) over o as l1, lag(f_rev, 4) over o as l4,
         avg(f_rev) over (partition by entity order by period_end rows between 2 preceding and current row) as m3,
         stddev_samp(f_rev) over (partition by entity order by period_end rows between 2 preceding and current row) as s3
  from reports window o as (partition by entity order by period_end))
select entity, period_end, round(l1, 4) as f_rev_lag1, round(f_rev - l1, 4) as f_rev_delta1, round((f_rev - l4) / {SAFE_SQL.format('l4')}, 6) as f_rev_growth4,
       round(m3, 4) as f_rev_mean3, round(s3, 4) as f_rev_std3 from w""")
def temporal_ops(spark, sf):
    ops = temporal.vocabulary((1, 4), (3,))
    d = temporal.add_temporal(panels.reports(spark, sf), ["f_rev"], "entity", "period_end", [ops[n] for n in ("lag1", "delta1", "growth4", "mean3", "std3")])
    d = d.select("entity", "period_end", "f_rev_lag1", "f_rev_delta1", "f_rev_growth4", "f_rev_mean3", "f_rev_std3")
    return rounded(rounded(d, "f_rev_lag1", "f_rev_delta1", "f_rev_mean3", "f_rev_std3", places=4), "f_rev_growth4")


def _leaf(name):
    return expr.Leaf(name)


def _growth(period=1):
    return temporal.TemporalOp("growth", period)


RATIO = expr.chain([_leaf("f_rev"), _leaf("f_qty")], ["/"])
MASKED = expr.Temporal(temporal.TemporalOp("lag", 1), _leaf("f_qty"))
NESTED = expr.Temporal(temporal.TemporalOp("mean", 2), expr.Temporal(_growth(), RATIO))
MIXED = expr.chain([_leaf("f_rev"), _leaf("f_n"), _leaf("f_disc"), MASKED], ["-", "*", "+"])


def _evaluated(spark, sf, population):
    d = panels.reports(spark, sf).withColumn("ok", F.lit(True))
    return expr.evaluate(d, population, "entity", "period_end", "ok")


@query(f"""with {REPORTS_SQL} select entity, period_end, round((f_rev - f_n) * f_disc, 4) as arith, round(f_rev / {SAFE_SQL.format('f_qty')}, 6) as ratio from reports""")
def expr_arithmetic(spark, sf):
    d = _evaluated(spark, sf, [expr.chain([_leaf("f_rev"), _leaf("f_n"), _leaf("f_disc")], ["-", "*"]), RATIO])
    return d.select("entity", "period_end", F.round("e0", 4).alias("arith"), F.round("e1", 6).alias("ratio"))


@query(f"""with {REPORTS_SQL} select entity, period_end, round(f_rev / {SAFE_SQL.format('(f_n - f_n)')}, 2) as guarded,
round(f_rev / {SAFE_SQL.format('(-f_const * 1e-9)')}, 2) as negative from reports""")
def expr_guarded_division(spark, sf):
    d = panels.reports(spark, sf)
    return d.select("entity", "period_end", F.round(safe_div(F.col("f_rev"), F.col("f_n") - F.col("f_n")), 2).alias("guarded"), F.round(safe_div(F.col("f_rev"), -F.col("f_const") * 1e-9), 2).alias("negative"))


@query(f"""with {REPORTS_SQL}, a as (
  select entity, period_end, f_rev / {SAFE_SQL.format('f_qty')} as x from reports where f_qty is not null and f_rev is not null),
g as (select *, lag(x) over (partition by entity order by period_end) as l from a),
h as (select entity, period_end, (x - l) / {SAFE_SQL.format('l')} as g from g),
m as (select *, avg(g) over (partition by entity order by period_end rows between 1 preceding and current row) as v from h)
select r.entity, r.period_end, round(m.v, 6) as nested, m.entity is not null as survives from reports r left join m using (entity, period_end)""")
def expr_nested_temporal(spark, sf):
    return _evaluated(spark, sf, [NESTED]).select("entity", "period_end", F.round("e0", 6).alias("nested"), F.col("m0").alias("survives"))


@query(f"""with {REPORTS_SQL}, a as (select entity, period_end, lag(f_qty) over (partition by entity order by period_end) as l from reports where f_qty is not null)
select r.entity, r.period_end, round((f_rev - f_n) * f_disc + l, 4) as mixed, a.entity is not null as survives
from reports r left join a using (entity, period_end)""")
def expr_masked_lag(spark, sf):
    return _evaluated(spark, sf, [MIXED]).select("entity", "period_end", F.round("e0", 4).alias("mixed"), F.col("m0").alias("survives"))


@query(f"""with {REPORTS_SQL}, b as (select quantile_disc(f_rev, 0.01) as lo, quantile_disc(f_rev, 0.99) as hi from reports where year(period_end) <= 1998)
select entity, period_end, round(greatest(least(f_rev, hi), lo), 4) as f_rev from reports, b""")
def winsorize_train_bounds(spark, sf):
    d = expr.winsorize(panels.reports(spark, sf).select("entity", "period_end", "f_rev"), F.year("period_end") <= 1998, ["f_rev"])
    return rounded(d, "f_rev", places=4)


# --- quality and profiling

LONG_SQL = "select unnest(['f_qty', 'f_rev', 'f_disc', 'f_n', 'f_const']) as feature, unnest([f_qty, f_rev, f_disc, f_n, f_const]) as x, entity, sector, period_end from reports"


@query(f"with {REPORTS_SQL}, l as ({LONG_SQL}) select feature, round(avg((x is null or isnan(x))::int), 6) as missing_share from l group by 1")
def missingness(spark, sf):
    return rounded(quality.missing_shares(panels.reports(spark, sf), FEATURES), "missing_share")


@query(f"""with {REPORTS_SQL}, l as ({LONG_SQL}),
e as (select feature, entity, stddev_samp(coalesce(x, 0)) as s, sqrt(avg(coalesce(x, 0) ** 2)) as r from l group by 1, 2)
select feature, round(avg((s is not null and (r = 0 or s < 0.10 * r))::int), 6) as static_share from e group by 1""")
def static_flag(spark, sf):
    return rounded(quality.static_shares(panels.reports(spark, sf), FEATURES, "entity"), "static_share")


@query(f"""with {REPORTS_SQL}, l as ({LONG_SQL}), e as (select feature, entity, max((x is not null)::int) as c from l group by 1, 2),
s as (select feature, sector, max((x is not null)::int) as c from l group by 1, 2)
select 'entity' as grain, feature, round(avg(c), 6) as covered from e group by 2 union all select 'sector', feature, round(avg(c), 6) from s group by 2""")
def coverage(spark, sf):
    d = panels.reports(spark, sf)
    one = lambda g: quality.coverage(d, FEATURES, g).select(F.lit(g).alias("grain"), "feature", F.round("covered", 6).alias("covered"))
    return one("entity").unionByName(one("sector"))


@query(f"""with {REPORTS_SQL} select 'f_rev' as feature, count(*) filter (entity % 5 = 0) as infinities from reports union all select 'f_n', 0 from (select 1)""")
def infinity_count(spark, sf):
    d = panels.reports(spark, sf).withColumn("f_rev", F.when(F.col("entity") % 5 == 0, F.lit(float("-inf"))).otherwise(F.col("f_rev")))
    return quality.infinity_counts(d, ["f_rev", "f_n"])


@query(f"""with {REPORTS_SQL}, l as ({LONG_SQL}), g as (
  select feature, date_diff('day', lag(period_end) over (partition by feature, entity order by period_end), period_end) as days from l where x is not null),
c as (select feature, days, count(*) as n from g where days is not null group by 1, 2),
m as (select feature, days::int as days from c qualify row_number() over (partition by feature order by n desc, days) = 1)
select feature, days, case when days < 45 then 'monthly' when days < 135 then 'quarterly' else 'annual' end as frequency from m""")
def interval_frequency(spark, sf):
    return profile.reporting_frequency(panels.reports(spark, sf), FEATURES, "entity", "period_end")


@query(f"""with {AVAILABLE_SQL}, l as (select lag from avail where lag >= 0), k as (select unnest([31, 45, 60, 90, 120])::int as within)
select within, round(avg((lag <= within)::int), 6) as share from l, k group by 1""")
def filing_delay(spark, sf):
    d = panels.reports(spark, sf).withColumn("lag", F.datediff("src_date", "period_end"))
    return rounded(profile.attainment(d, "lag"), "share")


@query(f"""with {REPORTS_SQL} select case when f_n < 0 then 0 when f_n >= 60 then 13 else 1 + floor(f_n / 5)::int end::int as bucket, count(*) as n from reports group by 1""")
def histogram(spark, sf):
    return profile.histogram(panels.reports(spark, sf), "f_n", 0.0, 60.0, 12)


@query(f"""with {REPORTS_SQL}, l as ({LONG_SQL}), m as (select feature, avg(x) as m from l group by 1),
c as (select l.feature, count(x) as n, avg((x - m) ** 2) as m2, avg((x - m) ** 3) as m3, avg((x - m) ** 4) as m4 from l join m using (feature) where x is not null group by 1),
d as (select feature, avg(x) as mean, stddev_samp(x) as sd, min(x) as least, max(x) as most, quantile_disc(x, 0.5) as median from l group by 1)
select feature, n, round(mean, 4) as mean, round(sd, 4) as sd, round(least, 4) as least, round(most, 4) as most, round(median, 4) as median,
       round(case when least < most then m3 / m2 ** 1.5 end, 4) as skew, round(case when least < most then m4 / m2 ** 2 - 3 end, 4) as kurtosis
from d join c using (feature)""")
def describe(spark, sf):
    return rounded(profile.describe(panels.reports(spark, sf), FEATURES), "mean", "sd", "least", "most", "median", "skew", "kurtosis", places=4)


@query(f"""with {REPORTS_SQL}, l as ({LONG_SQL}), s as (select feature, avg((x is null)::int) as share from l group by 1),
b as (select unnest([0.0, 0.01, 0.05, 0.10, 0.20, 0.30, 0.50, 0.75])::double as band)
select max_band as band, count(*) as features from (select feature, max(band) as max_band from s join b on share >= band group by 1) group by 1""")
def missing_bands(spark, sf):
    return profile.missing_bands(panels.reports(spark, sf), FEATURES)


@query(f"""with {REPORTS_SQL}, {SPARSE_SQL},
a as (select date_trunc('month', period_end)::date as month, count(distinct entity) as reports from reports group by 1),
b as (select month, count(distinct entity) as orders from sparse group by 1)
select coalesce(a.month, b.month) as month, coalesce(reports, 0) as reports, coalesce(orders, 0) as orders from a full join b on a.month = b.month""")
def coverage_by_month(spark, sf):
    a = panels.reports(spark, sf).select("entity", F.col("period_end").alias("day"))
    b = panels.sparse_months(spark, sf).select("entity", F.col("month").alias("day"))
    return profile.coverage_by_month({"reports": a, "orders": b}, "entity", "day")


@query(f"""with {REPORTS_SQL}, {PRICES_SQL}
select 'reports' as frame, count(*) as rows, count(distinct entity) as entities, min(period_end) as first, max(period_end) as last from reports
union all select 'prices', count(*), count(distinct entity), min(p_date), max(p_date) from prices""")
def dataset_scope(spark, sf):
    return profile.scope({"reports": (panels.reports(spark, sf), "entity", "period_end"), "prices": (panels.prices(spark, sf), "entity", "p_date")})


@query("""with e as (select user_id, ts::date as day, sum(value)::double as total from events group by 1, 2),
g as (select *, date_diff('day', lag(day) over (partition by user_id order by day), day)::int as days from e)
select user_id, count(*) as rows, min(day) as first, max(day) as last, max(days) as most_gap, count(distinct year(day)) as years from g group by 1""")
def company_observations(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("total"))
    return profile.company_observations(d, "user_id", "day")


@query(f"""with {RETURNS_SQL} select month, count(*) as n, round(avg(monthly_return), 6) as mean, round(stddev_samp(monthly_return), 6) as sd,
round(quantile_disc(monthly_return, 0.5), 6) as median, round(quantile_disc(monthly_return, 0.05), 6) as low, round(quantile_disc(monthly_return, 0.95), 6) as high
from ret group by 1""")
def return_cross_section(spark, sf):
    return rounded(profile.cross_section(_returns(spark, sf), "month", "monthly_return"), "mean", "sd", "median", "low", "high")


@query("""select distinct c_custkey, c_nationkey from customer
qualify row_number() over (partition by c_nationkey order by md5('7:' || c_custkey), c_custkey) <= 3""")
def sample_entities(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return quality.sample_entities(d, "c_custkey", "c_nationkey", 3, 7)


# --- folds

FOLD_YEARS = (1, 2, 2)


def _folds(spark, sf):
    return folds.fold_boundaries(folds.years_of(panels.reports(spark, sf), "period_end"), *FOLD_YEARS)


@query(f"""with {REPORTS_SQL}, y as (select distinct year(period_end)::int as y from reports), n as (select count(*) as n, min(y) as y0 from y),
r as (select y, row_number() over (order by y) as k, n, y0 from y, n),
d as (select y, y0, case when k > n - 2 then 'final_test' else 'development' end as category from r where k > n - 2 or k >= greatest(0, n - 2 - 2 - 1) + 2)
select category, 'fold_0' || row_number() over (partition by category order by y) as fold, y0 as train_from,
       case category when 'final_test' then y - 2 else y - 1 end as train_to, case category when 'final_test' then y - 1 else -1 end as validation, y as test from d""")
def fold_boundaries(spark, sf):
    rows = [(f.category, f.name, f.train[0], f.train[1], f.validation[0] if f.validation else -1, f.test[0]) for f in _folds(spark, sf)]
    return spark.createDataFrame(rows, "category string, fold string, train_from int, train_to int, validation int, test int")


@query(f"""with {EXPANDED_SQL}, s as (
  select case when target_date <= date '1998-11-30' then 'train' when target_date between date '1999-01-01' and date '1999-11-30' then 'validation'
              when year(target_date) = 2000 then 'test' end as split, target_date, entity from panel)
select split, count(*) as n, count(distinct entity) as entities, min(target_date) as first, max(target_date) as last from s where split is not null group by 1""")
def embargo_split(spark, sf):
    fold = folds.Fold("fold_01", "final_test", (1990, 1998), (2000, 2000), (1999, 1999))
    d = folds.split(_panel(spark, sf), fold, "target_date", 1)
    return d.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"), F.min("target_date").alias("first"), F.max("target_date").alias("last"))


# --- rank metrics

PREDICTIONS_SQL = f"""{RETURNS_SQL},
pred as (
  select entity, month, round(adj_price / 100, 0) as prediction, lead(monthly_return) over (partition by entity order by month) as label from ret),
predictions as (select * from pred where label is not null)"""
IC_SQL = """rk as (
  select month, rank() over (partition by month order by prediction) + (count(*) over (partition by month, prediction) - 1) / 2.0 as x,
         rank() over (partition by month order by label) + (count(*) over (partition by month, label) - 1) / 2.0 as y from predictions),
ics as (select month, count(*) as n, corr(x, y) as ic from rk group by 1 having count(distinct x) > 1 and count(distinct y) > 1)"""


def _predictions(spark, sf):
    label = F.lead("monthly_return").over(Window.partitionBy("entity").orderBy("month"))
    d = _returns(spark, sf).withColumns({"prediction": F.round(F.col("adj_price") / 100, 0), "label": label})
    return d.where("label is not null").select("entity", "month", "prediction", "label")


@query(f"with {PREDICTIONS_SQL}, {IC_SQL} select month, round(ic, 6) + 0.0 as ic, n from ics")
def monthly_rank_ic(spark, sf):
    return rounded(rk.monthly_rank_ic(_predictions(spark, sf)).select("month", "ic", "n"), "ic")


@query(f"with {PREDICTIONS_SQL}, {IC_SQL} select round(avg(ic), 6) + 0.0 as mean_ic, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) + 0.0 as ic_ir, count(*) as months from ics")
def ic_summary(spark, sf):
    return rounded(rk.monthly_rank_ic(_predictions(spark, sf)).agg(*rk.ic_summary(F.col("ic"))), "mean_ic", "ic_ir")


@query(f"""with {PREDICTIONS_SQL} select year(month)::int as year, round(sqrt(avg((label - prediction / 1000) ** 2)), 6) as rmse, count(*) as n from predictions group by 1""")
def pooled_rmse(spark, sf):
    d = _predictions(spark, sf).withColumn("prediction", F.col("prediction") / 1000).withColumn("year", F.year("month"))
    return rounded(model.errors(d, "label", ("year",)), "rmse")


@query(f"""with {EXPANDED_SQL}, l as (
  select unnest(['f_qty', 'f_rev', 'f_disc', 'f_n', 'f_const']) as feature, unnest([f_qty, f_rev, f_disc, f_n, f_const]) as x, monthly_return as y from panel),
b as (select * from l where x is not null)
select f.feature, round(case when min(x) < max(x) then corr(x, y) end, 6) as correlation
from (select unnest(['f_qty', 'f_rev', 'f_disc', 'f_n', 'f_const']) as feature) f left join b using (feature) group by 1""")
def pearson_target(spark, sf):
    return rounded(quality.pearson(_panel(spark, sf), FEATURES, "monthly_return"), "correlation")


@query(f"""with {REPORTS_SQL}, p as (
  select unnest(['f_qty', 'f_rev', 'f_qty']) as a, unnest(['f_rev', 'f_n', 'f_disc']) as b, unnest([f_qty, f_rev, f_qty]) as x, unnest([f_rev, f_n, f_disc]) as y from reports),
k as (
  select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0 as x,
         rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2.0 as y from p where x is not null and y is not null)
select a, b, round(corr(x, y), 6) as rho, count(*) as n from k group by 1, 2""")
def pairwise_spearman(spark, sf):
    return rounded(rk.spearman(panels.reports(spark, sf), [("f_qty", "f_rev"), ("f_rev", "f_n"), ("f_qty", "f_disc")]), "rho")


# --- selection, significance, comparison

SCORES = [(f"x{k}", m, ((k * a + b) % 17) / 17.0) for m, a, b in (("spearman", 5, 3), ("mutual", 7, 1), ("forest", 3, 8)) for k in range(12)]
SCORES_SQL = "scores as (select * from (values " + ", ".join(f"('{f}', '{m}', {s}::double)" for f, m, s in SCORES) + ") t(feature, method, score))"
VOTES_SQL = f"""{SCORES_SQL},
pct as (
  select *, (rank() over (partition by method order by score) + (count(*) over (partition by method, score) - 1) / 2.0) / count(*) over (partition by method) as p from scores),
votes as (select feature, count(*) filter (p >= 0.60) as votes, avg(p) as consensus_score from pct group by 1)"""


def _scores(spark):
    return spark.createDataFrame(SCORES, "feature string, method string, score double")


@query(f"with {VOTES_SQL} select feature, votes, round(consensus_score, 6) as consensus_score, votes >= 2 as kept from votes")
def consensus_vote(spark, sf):
    return rounded(selection.consensus(_scores(spark)), "consensus_score")


@query(f"""with {VOTES_SQL} select feature, cluster, round(consensus_score, 6) as consensus_score from (
  select *, substr(feature, 2)::int % 4 as cluster, (substr(feature, 2)::int * 3 % 5) / 10.0 as missing_share from votes)
qualify row_number() over (partition by cluster order by consensus_score desc, missing_share, feature) = 1""")
def representative_pick(spark, sf):
    k = F.substring("feature", 2, 9).cast("int")
    d = selection.consensus(_scores(spark)).withColumns({"cluster": k % 4, "missing_share": (k * 3 % 5) / 10.0, "company_coverage": F.lit(1.0), "sector_coverage": F.lit(1.0), "spearman": F.lit(0.0)})
    return rounded(selection.representatives(d).select("feature", "cluster", "consensus_score"), "consensus_score")


P_VALUES = [(k, p) for k, p in enumerate([0.01, 0.04, 0.03, 0.005, 0.04, 0.9])]


@query(f"""with p as (select * from (values {", ".join(f"({k}, {p}::double)" for k, p in P_VALUES)}) t(position, p_value)),
s as (select *, (count(*) over () - row_number() over (order by p_value, position) + 1) * p_value as s from p)
select position, p_value, round(least(1.0, max(s) over (order by p_value, position)), 6)::double as adjusted from s""")
def holm(spark, sf):
    return rounded(compare.holm(spark.createDataFrame(P_VALUES, "position int, p_value double")), "adjusted")


MATCHED_SQL = f"""{ARM_SQL},
matched as (
  select a.fold, a.seed, a.month, a.ic as on_ic, b.ic as off_ic, a.ic - b.ic as delta
  from arm_ic a join arm_ic b using (fold, seed, month, predictor) where a.arm = 'on' and b.arm = 'off' and predictor = 'winner'),
averaged as (select fold, month, avg(on_ic) as on_ic, avg(off_ic) as off_ic, avg(delta) as delta from matched group by 1, 2)"""


@query(f"with {MATCHED_SQL} select fold, month, round(on_ic, 6) as on_ic, round(off_ic, 6) as off_ic, round(delta, 6) as delta from averaged")
def seed_averaged_delta(spark, sf):
    return rounded(compare.seed_averaged(panels.arm_ic(spark, sf)), "on_ic", "off_ic", "delta")


@query(f"with {MATCHED_SQL} select fold, seed, month, round(on_ic, 6) as on_ic, round(off_ic, 6) as off_ic, round(delta, 6) as delta from matched")
def per_seed_delta(spark, sf):
    return rounded(compare.seed_deltas(panels.arm_ic(spark, sf)), "on_ic", "off_ic", "delta")


@query(f"""with {MATCHED_SQL} select arm, round(avg(ic), 6) as mean_ic, round(avg(ic) / stddev_samp(ic), 6) as ic_ir, count(*) as months
from (select 'on' as arm, on_ic as ic from averaged union all select 'off', off_ic from averaged) group by 1""")
def arm_levels(spark, sf):
    d = compare.seed_averaged(panels.arm_ic(spark, sf)).unpivot(["fold", "month"], [F.col("on_ic").alias("on"), F.col("off_ic").alias("off")], "arm", "ic")
    return rounded(d.groupBy("arm").agg(*rk.ic_summary(F.col("ic"))), "mean_ic", "ic_ir")


@query(f"""with {MATCHED_SQL}, f as (select fold, avg(on_ic) as on_ic, avg(off_ic) as off_ic, avg(delta) as delta from averaged group by 1)
select fold, round(on_ic, 6) as on_ic, round(off_ic, 6) as off_ic, round(delta, 6) as delta from f
union all select 'mean', round(avg(on_ic), 6), round(avg(off_ic), 6), round(avg(delta), 6) from f""")
def fold_rank_ic(spark, sf):
    d = compare.seed_averaged(panels.arm_ic(spark, sf)).groupBy("fold").agg(*[F.avg(c).alias(c) for c in ("on_ic", "off_ic", "delta")])
    return rounded(compare.with_mean_row(d, "fold"), "on_ic", "off_ic", "delta")


def _within_sql(predictors: list[str]) -> str:
    picks = ", ".join(f"max(case when predictor = '{p}' then ic end) as {p}" for p in predictors)
    return f"w as (select arm, fold, seed, month, {picks} from arm_ic group by 1, 2, 3, 4), m as (select arm, fold, month, {', '.join(f'avg({p}) as {p}' for p in predictors)} from w where {' and '.join(f'{p} is not null' for p in predictors)} group by 1, 2, 3)"


@query(f"with {ARM_SQL}, {_within_sql(['winner', 'base_c'])} select fold, month, round(winner, 6) as winner, round(base_c, 6) as base_c from m where arm = 'on'")
def within_arm_two_way(spark, sf):
    return rounded(compare.within_arm(panels.arm_ic(spark, sf), "on", ["winner", "base_c"]), "winner", "base_c")


@query(f"with {ARM_SQL}, {_within_sql(['winner', 'base_a', 'base_c'])} select fold, month, round(winner, 6) as winner, round(base_a, 6) as base_a, round(base_c, 6) as base_c from m where arm = 'off'")
def within_arm_n_way(spark, sf):
    return rounded(compare.within_arm(panels.arm_ic(spark, sf), "off", ["winner", "base_a", "base_c"]), "winner", "base_a", "base_c")


@query(f"""with {ARM_SQL}, {_within_sql(['winner', 'base_c'])}
select a.fold, a.month, round(a.winner - a.base_c, 6) + 0.0 as on_lift, round(b.winner - b.base_c, 6) + 0.0 as off_lift, round(a.winner - a.base_c - (b.winner - b.base_c), 6) + 0.0 as difference
from m a join m b using (fold, month) where a.arm = 'on' and b.arm = 'off'""")
def lift_difference(spark, sf):
    return rounded(compare.lifts(panels.arm_ic(spark, sf), "base_c"), "on_lift", "off_lift", "difference")


@query(f"""with {ARM_SQL} select arm, seed, round(avg(ic), 6) as mean_ic, round(avg(ic) / stddev_samp(ic), 6) as ic_ir, count(*) as months
from arm_ic where predictor = 'winner' group by 1, 2""")
def seed_level_ic(spark, sf):
    return rounded(compare.seed_levels(panels.arm_ic(spark, sf)), "mean_ic", "ic_ir")


WINNERS = [expr.chain([MASKED, NESTED], ["+"]), RATIO, NESTED, expr.chain([_leaf("f_n"), MASKED], ["*"])]


WINNERS_SQL = "winners as (select * from (values " + ", ".join(f"({k}, '{e}')" for k, e in enumerate(WINNERS)) + ") t(run, form))"


@query(f"""with {WINNERS_SQL}, u as (select run, unnest(list_distinct(regexp_extract_all(form, '([a-z]+)[0-9]+[(]', 1))) as family from winners)
select family, count(*) as winners, 100.0 * count(*) / (select count(*) from winners) as percent from u group by 1""")
def family_usage(spark, sf):
    d = spark.createDataFrame([(k, e.families()) for k, e in enumerate(WINNERS)], "run int, families array<string>")
    return compare.family_usage(d)


RUNS = [(k, "ab"[k % 3 == 0], [f"t{(k * s) % 7}" for s in range(4)], 0.08 + k / 1000, 0.03 - k / 500) for k in range(6)]


@query(f"""with r as (select * from (values {", ".join(f"({k}, '{w}', {t}, {x}::double, {y}::double)" for k, w, t, x, y in RUNS)}) v(run, winner, top, rmse, mean_ic)),
m as (select winner, count(*) as n from r group by 1 order by n desc, winner limit 1),
j as (select len(list_intersect(a.top, b.top)) / len(list_distinct(list_concat(a.top, b.top))) as j from r a join r b on a.run < b.run)
select (select winner from m) as modal_winner, round((select n from m) / count(*), 6) as champion_stability, (select round(avg(j), 6) from j) as top_k_overlap, count(*) as n_runs,
round(stddev_pop(rmse), 6) as rmse_std, round(max(rmse) - min(rmse), 6) as rmse_range, round(stddev_pop(mean_ic), 6) as mean_ic_std, round(max(mean_ic) - min(mean_ic), 6) as mean_ic_range from r""")
def stability(spark, sf):
    d = compare.stability(spark.createDataFrame(RUNS, "run int, winner string, top array<string>, rmse double, mean_ic double"))
    return rounded(d, "champion_stability", "top_k_overlap", "rmse_std", "rmse_range", "mean_ic_std", "mean_ic_range")


@query()
def block_bootstrap(spark, sf):
    """The draws come from the driver's generator, which SQL has not; tests hold it to plain Python."""
    d = compare.seed_averaged(panels.arm_ic(spark, sf)).select("fold", "month", "delta")
    lengths = {r["fold"]: r["count"] for r in d.groupBy("fold").count().orderBy("fold").collect()}
    found = resample.bootstrap(d, resample.draw_starts(spark, lengths))
    return compare.verdict(found.withColumnRenamed("observed", "delta"))


@query()
def seed_block_bootstrap(spark, sf):
    d = compare.seed_deltas(panels.arm_ic(spark, sf)).select("fold", "seed", "month", "delta")
    lengths = {r["fold"]: r["n"] for r in d.groupBy("fold").agg(F.countDistinct("month").alias("n")).orderBy("fold").collect()}
    drawn = resample.draw_seeds(spark, [100, 101, 102, 103], resample.REPLICATES)
    return resample.seed_bootstrap(d, drawn, resample.draw_starts(spark, lengths, seed=43))


# --- further profiling and reporting


@query(f"""with {REPORTS_SQL}, l as ({LONG_SQL}) select feature, count(distinct case when x is not null then entity end) as entities from l group by 1""")
def any_value_entities(spark, sf):
    d = panels.reports(spark, sf)
    per = d.groupBy("entity").agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in FEATURES])
    return quality.melt(per, {c: F.count_if(c) for c in FEATURES}, value="entities")


@query(f"""with {REPORTS_SQL}, l as ({LONG_SQL}) select feature, count(distinct x) as levels, round(var_samp(x), 4) as variance from l group by 1""")
def feature_variation(spark, sf):
    long = panels.reports(spark, sf).unpivot([], FEATURES, "feature", "x")
    return rounded(long.groupBy("feature").agg(F.countDistinct("x").alias("levels"), F.var_samp("x").alias("variance")), "variance", places=4)


@query(f"""with {REPORTS_SQL}, l as ({LONG_SQL}), m as (select feature, avg((x is null)::int) as share, stddev_samp(x) / nullif(abs(avg(x)), 0) as cv from l group by 1)
select arg_min(feature, (share, feature)) as fullest, arg_max(feature, (share, feature)) as emptiest, arg_max(feature, (cv, feature)) as widest, arg_min(feature, (cv, feature)) as narrowest from m""")
def representative_features(spark, sf):
    long = panels.reports(spark, sf).unpivot([], FEATURES, "feature", "x")
    m = long.groupBy("feature").agg(F.avg(F.col("x").isNull().cast("int")).alias("share"), F.try_divide(F.stddev_samp("x"), F.abs(F.avg("x"))).alias("cv"))
    at = lambda f, c: f("feature", F.struct(c, "feature"))
    return m.agg(at(F.min_by, "share").alias("fullest"), at(F.max_by, "share").alias("emptiest"), at(F.max_by, "cv").alias("widest"), at(F.min_by, "cv").alias("narrowest"))


@query(f"""with {REPORTS_SQL}, {PRICES_SQL}, s as (
  select log10(p.p_price * r.f_qty) as x from reports r asof join prices p on r.entity = p.entity and r.period_end >= p.p_date where p.p_price * r.f_qty > 0)
select case when x < 3 then 0 when x >= 8 then 11 else 1 + floor((x - 3) * 2)::int end::int as bucket, count(*) as n from s group by 1""")
def size_distribution(spark, sf):
    d = asof.asof_carry(panels.reports(spark, sf).select("entity", "period_end", "f_qty"), panels.prices(spark, sf), "p_price", "entity", "period_end", "entity", "p_date")
    size = F.col("p_price") * F.col("f_qty")
    return profile.histogram(d.where(size > 0).withColumn("x", F.log10(size)), "x", 3.0, 8.0, 10)


@query(f"""with {EXPANDED_SQL}
select 1 as stage, 'reports' as name, count(*) as rows, count(distinct entity) as entities from reports union all select 2, 'returns', count(*), count(distinct entity) from ret
union all select 3, 'expanded', count(*), count(distinct entity) from expanded union all select 4, 'panel', count(*), count(distinct entity) from panel""")
def stage_audit(spark, sf):
    found = None
    for k, (name, d) in enumerate([("reports", panels.reports(spark, sf)), ("returns", _returns(spark, sf)), ("expanded", _expanded(spark, sf)), ("panel", _panel(spark, sf))], 1):
        one = d.agg(F.count("*").alias("rows"), F.countDistinct("entity").alias("entities")).select(F.lit(k).alias("stage"), F.lit(name).alias("name"), "rows", "entities")
        found = one if found is None else found.unionByName(one)
    return found


@query(f"""with {REPORTS_SQL}, l as ({LONG_SQL}), f as (select unnest(range(1996, 2002)) as year),
m as (select year::int as year, feature, avg((x is null)::int) > 0.14 as dropped from l join f on year(period_end) < year group by 1, 2),
t as (select *, dropped <> lag(dropped) over (partition by feature order by year) as toggled from m)
select feature, count(*) filter (dropped) as dropped_in, count(*) filter (toggled) as toggles from t group by 1""")
def fold_drop_toggles(spark, sf):
    """Membership of the missingness drop as train windows grow; more than one toggle is not monotonic."""
    years = spark.range(1996, 2002).select(F.col("id").cast("int").alias("year"))  # six rows
    long = panels.reports(spark, sf).withColumn("_y", F.year("period_end")).unpivot(["_y"], FEATURES, "feature", "x")
    counts = long.groupBy("_y", "feature").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("gone"))
    m = counts.join(F.broadcast(years), F.col("_y") < F.col("year")).groupBy("year", "feature").agg((F.sum("gone") / F.sum("n") > 0.14).alias("dropped"))
    t = m.withColumn("toggled", F.col("dropped") != F.lag("dropped").over(Window.partitionBy("feature").orderBy("year")))
    return t.groupBy("feature").agg(F.count_if("dropped").alias("dropped_in"), F.count_if("toggled").alias("toggles"))


@query(f"""with {PREDICTIONS_SQL}, e as (select entity % 3 as seed, year(month) as fold, sqrt(avg((label - prediction / 1000) ** 2)) as rmse from predictions group by 1, 2)
select fold::int as fold, round(avg(rmse), 6) as rmse, count(*) as seeds from e group by 1""")
def seed_averaged_rmse(spark, sf):
    d = _predictions(spark, sf).withColumns({"prediction": F.col("prediction") / 1000, "seed": F.col("entity") % 3, "fold": F.year("month")})
    return rounded(model.errors(d, "label", ("seed", "fold")).groupBy("fold").agg(F.avg("rmse").alias("rmse"), F.count("*").alias("seeds")), "rmse")


@query(f"""with {ARM_SQL}, {_within_sql(['winner', 'base_c'])}, d as (
  select a.fold, a.month, a.winner - a.base_c as on_lift, b.winner - b.base_c as off_lift from m a join m b using (fold, month) where a.arm = 'on' and b.arm = 'off')
select fold, round(avg(on_lift), 6) + 0.0 as on_lift, round(avg(off_lift), 6) + 0.0 as off_lift, round(avg(on_lift - off_lift), 6) + 0.0 as difference, count(*) as months from d group by 1""")
def attribution(spark, sf):
    d = compare.lifts(panels.arm_ic(spark, sf), "base_c").groupBy("fold")
    return rounded(d.agg(*[F.avg(c).alias(c) for c in ("on_lift", "off_lift", "difference")], F.count("*").alias("months")), "on_lift", "off_lift", "difference")


@query(f"""with {ARM_SQL}, {_within_sql(['winner', 'base_a', 'base_c'])},
l as (select arm, unnest(['winner', 'base_a', 'base_c']) as predictor, unnest([winner, base_a, base_c]) as ic from m)
select arm, predictor, round(avg(ic), 6) + 0.0 as mean_ic, round(avg(ic) / stddev_samp(ic), 6) + 0.0 as ic_ir, count(*) as months from l group by 1, 2""")
def predictor_comparison(spark, sf):
    ic, names, out = panels.arm_ic(spark, sf), ["winner", "base_a", "base_c"], None
    for arm in ("on", "off"):
        d = compare.within_arm(ic, arm, names).unpivot(["fold", "month"], names, "predictor", "ic")
        one = d.groupBy("predictor").agg(*rk.ic_summary(F.col("ic"))).select(F.lit(arm).alias("arm"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out, "mean_ic", "ic_ir")


@query(f"""with {ARM_SQL}, {_within_sql(['winner', 'base_a', 'base_c'])},
l as (select arm, 'base_a' as baseline, winner - base_a as lift from m union all select arm, 'base_c', winner - base_c from m),
t as (select arm, baseline, avg(lift) as lift, least(1.0, exp(-avg(lift) * 10) / 10)::double as p_value from l group by 1, 2),
s as (select *, (count(*) over (partition by arm) - row_number() over (partition by arm order by p_value, baseline) + 1) * p_value as s from t)
select arm, baseline, round(lift, 6) + 0.0 as lift, round(p_value, 6) as p_value, round(least(1.0, max(s) over (partition by arm order by p_value, baseline))::double, 6) as adjusted from s""")
def baseline_family(spark, sf):
    """Holm within each arm's family of baselines; the p-values are a fixed rule of the lifts."""
    ic, names, out = panels.arm_ic(spark, sf), ["winner", "base_a", "base_c"], None
    for arm in ("on", "off"):
        d = compare.within_arm(ic, arm, names).agg(*[F.avg(F.col("winner") - F.col(b)).alias(b) for b in names[1:]])
        one = d.unpivot([], names[1:], "baseline", "lift").select(F.lit(arm).alias("arm"), "baseline", "lift")
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("p_value", F.least(F.lit(1.0), F.exp(-F.col("lift") * 10) / 10))
    return rounded(compare.holm(out, order="baseline", family=("arm",)), "lift", "p_value", "adjusted")


ARM_WINNERS = [(f"fold_0{k + 1}", a, e) for a, shift in (("on", 0), ("off", 1)) for k, e in enumerate(WINNERS[shift:] + WINNERS[:shift])]
#: Leaves are names of columns; the depth is the most brackets open at once (no chain is bracketed here).
SIZES_SQL = f"""w as (select * from (values {", ".join(f"('{f}', '{a}', '{e}')" for f, a, e in ARM_WINNERS)}) t(fold, arm, form)),
s as (
  select fold, arm, len(regexp_extract_all(form, 'f_[a-z]+'))::int as leaves,
         list_max([len(regexp_replace(form[1:i], '[^(]', '', 'g')) - len(regexp_replace(form[1:i], '[^)]', '', 'g')) for i in range(len(form) + 1)])::int as depth from w)"""


def _sizes(spark):
    rows = [(f, a, len(e.leaves()), e.depth()) for f, a, e in ARM_WINNERS]
    return spark.createDataFrame(rows, "fold string, arm string, leaves int, depth int")


@query(f"""with {SIZES_SQL}
select a.fold, a.leaves as on_leaves, b.leaves as off_leaves, a.depth as on_depth, b.depth as off_depth from s a join s b using (fold) where a.arm = 'on' and b.arm = 'off'""")
def expression_sizes(spark, sf):
    d = _sizes(spark)
    one = lambda arm: d.where(F.col("arm") == arm).select("fold", F.col("leaves").alias(f"{arm}_leaves"), F.col("depth").alias(f"{arm}_depth"))
    return one("on").join(one("off"), "fold").select("fold", "on_leaves", "off_leaves", "on_depth", "off_depth")


@query(f"""with {SIZES_SQL}, j as (
  select a.fold, a.leaves::double as on_leaves, a.depth::double as on_depth, b.leaves::double as off_leaves, b.depth::double as off_depth, (a.leaves - b.leaves)::double as leaves_delta, (a.depth - b.depth)::double as depth_delta
  from s a join s b using (fold) where a.arm = 'on' and b.arm = 'off')
select * from j union all select 'mean', avg(on_leaves), avg(on_depth), avg(off_leaves), avg(off_depth), avg(leaves_delta), avg(depth_delta) from j""")
def composition_deltas(spark, sf):
    return reporting.composition(_sizes(spark))


# --- catalog, columns, runs


@query("""select o_orderpriority, count(*) as n, round(sum(o_totalprice)::double, 2) as total from orders
where o_orderdate >= date '1996-01-01' and o_orderstatus in ('F', 'O') group by 1""")
def catalog_sql(spark, sf):
    text = "select o_orderpriority, count(*) as n, round(cast(sum(o_totalprice) as double), 2) as total from {orders} where o_orderdate >= :since and o_orderstatus in (:a, :b) group by 1"
    return io.catalog_sql(spark, text, {"orders": table(spark, sf, "orders")}, since=date(1996, 1, 1), a="F", b="O")


@query(f"""with {PRICES_SQL}
select distinct p.entity, p.p_date, round(p.p_price, 6) as p_price, n_name, r_name, s_name, p.dividend, case when p.dividend is not null then spinoff end as spinoff, p.split_factor
from prices p join supplier on s_suppkey = p.entity join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey""")
def price_join(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity"), "s_name", F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    d = px.price_join(*panels.price_parts(spark, sf), [s, n, table(spark, sf, "region").select("r_regionkey", "r_name")])
    return rounded(d.select("entity", "p_date", "p_price", "n_name", "r_name", "s_name", "dividend", "spinoff", "split_factor"), "p_price")


@query(f"with {REPORTS_SQL} select entity, period_end, round(f_rev, 4) as f_rev, round(f_n, 4) as f_n from reports")
def selected_columns(spark, sf):
    d, structural = panels.reports(spark, sf), ["entity", "period_end", "sector", "src_date"]
    picked = [c for c in quality.candidates(d, structural) if c in ("f_rev", "f_n", "f_qty")]
    d = quality.delete_features(quality.apply_selected(d, picked, structural), ["f_qty", "entity"], structural)
    return rounded(d.select("entity", "period_end", "f_rev", "f_n"), "f_rev", "f_n", places=4)


@query(f"""with {REPORTS_SQL}, l as (
  select feature as f, unnest([f_qty, f_rev, f_disc, f_n]) as x, unnest(['f_qty', 'f_rev', 'f_disc', 'f_n']) as c, entity, period_end from reports, (select 1 as feature)),
p as (select a.c as a, b.c as b, coalesce(a.x, 0) as x, coalesce(b.x, 0) as y from l a join l b using (entity, period_end) where a.c <> b.c),
k as (select a, b, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0 as x,
         rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2.0 as y from p)
select a, b, round(corr(x, y), 6) + 0.0 as rho from k group by 1, 2 union all select c, c, 1.0 from (select unnest(['f_qty', 'f_rev', 'f_disc', 'f_n']) as c)""")
def spearman_matrix(spark, sf):
    return rounded(rk.spearman_matrix(panels.reports(spark, sf), ["f_qty", "f_rev", "f_disc", "f_n"]), "rho")


PAIRS_SQL = f"""{REPORTS_SQL}, v as (select * from reports where f_qty is not null),
t as (select unnest([abs(corr(f_qty, f_rev)), abs(corr(f_qty, f_n)), abs(corr(f_rev, f_n)), abs(corr(f_qty, f_disc))]) as rho from v)"""


@query(f"""with {PAIRS_SQL} select unnest([0.1, 0.5, 0.9])::double as threshold, unnest([count(*) filter (rho >= 0.1), count(*) filter (rho >= 0.5), count(*) filter (rho >= 0.9)]) as pairs from t""")
def correlation_thresholds(spark, sf):
    d = panels.reports(spark, sf).where("f_qty is not null")
    made = {f"{a}:{b}": F.corr(a, b) for a, b in (("f_qty", "f_rev"), ("f_qty", "f_n"), ("f_rev", "f_n"), ("f_qty", "f_disc"))}
    return reporting.threshold_counts(quality.melt(d, made, value="rho"), (0.1, 0.5, 0.9))


@query(f"""with {EXPANDED_SQL}, l as (select unnest(['f_qty', 'f_rev', 'f_disc', 'f_n', 'f_const']) as feature, unnest([f_qty, f_rev, f_disc, f_n, f_const]) as x from panel),
t as (select count(monthly_return) as n, avg(monthly_return) as mean, stddev_samp(monthly_return) as sd, min(monthly_return) as least, max(monthly_return) as most from panel)
select feature, round(avg((x is null)::int), 6) as missing_share, count(*) filter (isinf(x)) as infinities, any_value(n) as n, round(any_value(mean), 6) as mean, round(any_value(sd), 6) as sd, round(any_value(least), 6) as least, round(any_value(most), 6) as most
from l, t group by 1""")
def eda_snapshot(spark, sf):
    return rounded(reporting.snapshot(_panel(spark, sf), FEATURES, "monthly_return"), "missing_share", "mean", "sd", "least", "most")


@query(f"""with {EXPANDED_SQL}
select (select count(*) from reports) as reports_rows, (select count(distinct entity) from reports) as reports_entities, (select count(*) from panel) as panel_rows,
       (select count(distinct target_date) from panel) as panel_months, (select round(avg(monthly_return), 6) from ret) as returns_mean""")
def master_summary(spark, sf):
    reports = panels.reports(spark, sf).agg(F.count("*").alias("rows"), F.countDistinct("entity").alias("entities"))
    panel = _panel(spark, sf).agg(F.count("*").alias("rows"), F.countDistinct("target_date").alias("months"))
    returns = _returns(spark, sf).agg(F.round(F.avg("monthly_return"), 6).alias("mean"))
    return reporting.master({"reports": reports, "panel": panel, "returns": returns})


RESULTS_SQL = f"""{ARM_SQL}, results as (
  select arm, seed, fold, avg(ic) as mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) as ic_ir, sqrt(avg(ic * ic)) as rmse from arm_ic where predictor = 'winner' group by 1, 2, 3)"""


def _results(spark, sf):
    d = panels.arm_ic(spark, sf).where("predictor = 'winner'").groupBy("arm", "seed", "fold")
    return d.agg(F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"), F.sqrt(F.avg(F.col("ic") * F.col("ic"))).alias("rmse"))


@query(f"with {RESULTS_SQL} select arm || ':' || seed as run, count(*) as folds, round(avg(rmse), 6) + 0.0 as rmse, round(avg(mean_ic), 6) + 0.0 as mean_ic, round(avg(ic_ir), 6) + 0.0 as ic_ir from results group by 1")
def run_means(spark, sf):
    d = _results(spark, sf).withColumn("run", F.concat_ws(":", "arm", "seed"))
    return rounded(reporting.run_means(d), "rmse", "mean_ic", "ic_ir")


@query(f"""with {ARM_SQL}, w as (select * from arm_ic where predictor = 'winner'), m as (select arm, fold, month, avg(ic) as ic from w group by 1, 2, 3),
f as (select arm, fold, avg(ic) as mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) as ic_ir, count(*) as months from m group by 1, 2),
n as (select arm, fold, count(distinct seed) as seeds from w group by 1, 2), j as (select * from f join n using (arm, fold)),
a as (select arm, fold, mean_ic, ic_ir, months, seeds from j union all select arm, 'mean', avg(mean_ic), avg(ic_ir), sum(months), max(seeds) from j group by 1)
select arm, fold, round(mean_ic, 6) + 0.0 as mean_ic, round(ic_ir, 6) + 0.0 as ic_ir, months::bigint as months, seeds from a""")
def arm_fold_summary(spark, sf):
    return rounded(reporting.fold_summary(panels.arm_ic(spark, sf)), "mean_ic", "ic_ir")


@query(f"""with {RESULTS_SQL}, s as (select seed, avg(mean_ic) filter (arm = 'on') as n, avg(mean_ic) filter (arm = 'off') as f from results group by 1),
o as (select *, (n + f) / 2 as objective from s)
select seed, round(n, 6) + 0.0 as "on", round(f, 6) + 0.0 as "off", round(objective, 6) + 0.0 as objective, objective is not null and row_number() over (order by objective desc nulls last, seed) = 1 as best from o""")
def sweep_table(spark, sf):
    """The objective of a sweep, the mean of both arms, by the values of one setting (here the seed)."""
    return rounded(reporting.sweep_table(_results(spark, sf), "seed"), "on", "off", "objective")


@query(f"""with {ARM_SQL}, g as (
  select arm || ':' || seed as run, (year(month) * 12 + month(month) - 1995 * 12)::int as generation, round(max(ic), 6) as best, count(*)::int as diversity from arm_ic group by 1, 2),
s as (select *, max(best) over (partition by run order by generation) as so_far, max(best) over (partition by run order by generation rows between unbounded preceding and 1 preceding) as b from g),
t as (select *, greatest(so_far - b, 0.0) as gain from s),
u as (select *, max(case when b is null or gain > 0 then generation end) over (partition by run order by generation) as last from t)
select run, generation, round(best, 6) + 0.0 as best, diversity, round(so_far, 6) + 0.0 as so_far, round(case when b is not null then gain end, 6) + 0.0 as gain, (generation - last)::int as stale from u""")
def run_history(spark, sf):
    month = F.year("month") * 12 + F.month("month") - 1995 * 12
    d = panels.arm_ic(spark, sf).groupBy(F.concat_ws(":", "arm", "seed").alias("run"), month.cast("int").alias("generation"))
    d = reporting.history(d.agg(F.round(F.max("ic"), 6).alias("best"), F.count("*").cast("int").alias("diversity")))
    first = F.row_number().over(Window.partitionBy("run").orderBy("generation")) == 1
    return rounded(d.withColumn("gain", F.when(~first, F.col("gain"))), "best", "so_far", "gain")


# --- models (no SQL can train them)


def _split_panel(spark, sf):
    fold = folds.Fold("fold_01", "final_test", (1990, 1998), (2000, 2000), (1999, 1999))
    return folds.split(_panel(spark, sf).na.drop(subset=["prev_month_return", "prev_month_sector_return"]), fold, "target_date", 1)


def _scorer(spark, sf):
    return search.PanelScorer(_split_panel(spark, sf), FEATURES)


@query()
def gbt_fitness(spark, sf):
    """A generation's worth of expressions, fitted side by side with the operator's 85 trees."""
    scorer, rng = _scorer(spark, sf), random.Random(folds.derive_seed(42, "fitness"))
    grammar = expr.Grammar(["f_qty", "f_rev", "f_disc", "f_n"])
    forms = dict.fromkeys([RATIO, NESTED, MIXED, MASKED])
    while len(forms) < search.Settings().population:
        forms[expr.canonical(grammar.random(rng))] = None
    scores = scorer(list(forms))
    scorer.release()
    return spark.createDataFrame([(str(e), x) for e, x in scores.items()], "expression string, fitness double")


@query()
def spark_fit(spark, sf):
    """The distributed fit of one expression: for frames of more rows than one task may hold."""
    scorer = _scorer(spark, sf)
    d = expr.winsorize(scorer.frame([RATIO]), F.col("_train"), ["e0"])
    p = model.fit_predict(d.where("_train"), d.where("not _train"), [*scorer.predictors, "e0"], scorer.target, ["entity", "target_date"], 10)
    scorer.release()
    return model.errors(p, scorer.target)


@query()
def search_step(spark, sf):
    """Two generations (a search has 50 at most, and goes on until it is calm) at the default settings otherwise."""
    scorer = _scorer(spark, sf)
    grammar = expr.Grammar(["f_qty", "f_rev", "f_disc", "f_n"])
    best, state, known = search.search(scorer, grammar, search.Settings(generations=2), folds.derive_seed(42, "fold_01"))
    scorer.release()
    return spark.createDataFrame([(str(e), x, e == best) for e, x in known.items()], "expression string, fitness double, best boolean")


@query()
def baseline_fit(spark, sf):
    """The two fixed predictors alone, and several expressions at once, on one fold."""
    panel = _split_panel(spark, sf)
    scorer = search.PanelScorer(panel, FEATURES)
    fixed = search.baseline_predictions(panel, scorer)
    several, _ = scorer.held_out([RATIO, MIXED], together=True)
    return model.errors(fixed.unionByName(several), scorer.target, ("model",))


@query()
def random_baseline(spark, sf):
    """Random search over a generation's worth of forms."""
    scorer = _scorer(spark, sf)
    best, scores = search.random_search(scorer, expr.Grammar(["f_qty", "f_rev", "f_n"]), search.Settings().population, 42)
    scorer.release()
    return spark.createDataFrame([(str(e), x, e == best) for e, x in scores.items()], "expression string, fitness double, best boolean")


@query()
def feature_scores(spark, sf):
    """The three scores of the consensus at their defaults: 100 trees, five repeats."""
    d, columns = _panel(spark, sf), ["f_qty", "f_rev", "f_disc", "f_n"]
    found = {"spearman": model.spearman_scores(d, columns, "monthly_return"), "mutual": model.mutual_information(d, columns, "monthly_return"), "forest": model.permutation_importance(d, columns, "monthly_return")}
    out = None
    for method, scores in found.items():
        one = scores.select("feature", F.lit(method).alias("method"), "score")
        out = one if out is None else out.unionByName(one)
    return out


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
