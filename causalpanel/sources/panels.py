"""Panels derived from the driver's tables, with the same definitions as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalpanel.functions.guards import safe_corr
from causalpanel.session import table


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per entity (supplier) and quarter: entity, sector, period_end, f_*, src_date."""
    q = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("entity"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("qs")
    ).agg(
        F.sum("l_quantity").cast("double").alias("s_qty"), F.sum("l_extendedprice").cast("double").alias("s_rev"),
        F.avg("l_discount").cast("double").alias("a_disc"), F.count("*").alias("n"),
    )
    places = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    places = places.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    places = places.join(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
    end = F.last_day(F.add_months("qs", 2))
    late = F.date_add(F.col("period_end"), (F.col("entity") * 7 % 60).cast("int"))
    d = q.join(places, F.col("entity") == F.col("s_suppkey")).withColumn("period_end", end)
    return d.select(
        "entity", F.col("r_name").alias("sector"), "period_end",
        F.when((F.col("entity") + F.quarter("qs")) % 7 != 0, F.col("s_qty")).alias("f_qty"),
        F.col("s_rev").alias("f_rev"), F.col("a_disc").alias("f_disc"), F.col("n").cast("double").alias("f_n"), F.lit(1.0).alias("f_const"),
        F.when(F.col("entity") % 11 == 0, F.lit(None).cast("date")).when(F.col("entity") % 13 == 0, F.date_sub("period_end", 10)).otherwise(late).alias("src_date"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, p_date, p_price, split_factor, dividend, spinoff: one row per entity and trading day."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("p_date"))
    d = d.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).cast("double").alias("p_price"))
    day = F.dayofmonth("p_date")
    split = F.when((day == 15) & (F.col("entity") % 3 == 0), 2.0).when((day == 20) & (F.col("entity") % 5 == 0), 0.5)
    return d.select("*", split.alias("split_factor"), F.when(day == 10, 0.5).alias("dividend"), F.when(F.col("entity") % 7 == 0, 1).when(F.col("entity") % 7 == 1, 0).alias("spinoff"))


def sparse_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity (customer), month, amount; with gap months."""
    month = F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity"), month).agg(F.sum("o_totalprice").cast("double").alias("amount"))


def price_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The price panel as three tables: prices, dividends by ex_date, splits by split_date."""
    d = prices(spark, sf_dir)
    paid = d.where("dividend is not null").select("entity", F.col("p_date").alias("ex_date"), "dividend", "spinoff")
    split = d.where("split_factor is not null").select("entity", F.col("p_date").alias("split_date"), "split_factor")
    return d.select("entity", "p_date", "p_price"), paid, split


def arm_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arm, seed, fold, month, predictor, ic: monthly correlations of two columns, by line, supplier and part."""
    d = table(spark, sf_dir, "lineitem").where(F.year("l_shipdate").between(1995, 1999))
    keys = [
        F.when(F.col("l_linenumber") % 2 == 0, "on").otherwise("off").alias("arm"), (F.col("l_suppkey") % 4 + 100).cast("int").alias("seed"),
        F.concat(F.lit("fold_0"), F.year("l_shipdate") - 1994).alias("fold"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"),
        F.element_at(F.array(F.lit("winner"), F.lit("base_a"), F.lit("base_c")), (F.col("l_partkey") % 3 + 1).cast("int")).alias("predictor"),
    ]
    x, y = F.col("l_discount").cast("double"), F.col("l_tax").cast("double")
    return d.groupBy(*keys).agg(safe_corr(x, y).alias("ic")).where("ic is not null")


#: The same panels for DuckDB; a query's SQL begins with ``with`` and the ones it needs.
REPORTS_SQL = """q as (
  select l_suppkey as entity, cast(date_trunc('quarter', l_shipdate) as date) as qs, sum(l_quantity)::double as s_qty,
         sum(l_extendedprice)::double as s_rev, avg(l_discount)::double as a_disc, count(*) as n
  from lineitem group by 1, 2),
reports as (
  select q.entity, r_name as sector, last_day(qs + interval 2 month) as period_end,
         case when (q.entity + quarter(qs)) % 7 = 0 then null else s_qty end as f_qty,
         s_rev as f_rev, a_disc as f_disc, n::double as f_n, 1.0::double as f_const,
         case when q.entity % 11 = 0 then null
              when q.entity % 13 = 0 then last_day(qs + interval 2 month) - 10
              else last_day(qs + interval 2 month) + cast((q.entity * 7) % 60 as integer) end::date as src_date
  from q join supplier on s_suppkey = q.entity join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey)"""
PRICES_SQL = """prices as (
  select l_suppkey as entity, l_shipdate::date as p_date, (sum(l_extendedprice) / sum(l_quantity))::double as p_price,
         case when day(l_shipdate::date) = 15 and l_suppkey % 3 = 0 then 2.0::double
              when day(l_shipdate::date) = 20 and l_suppkey % 5 = 0 then 0.5::double end as split_factor,
         case when day(l_shipdate::date) = 10 then 0.5::double end as dividend,
         case l_suppkey % 7 when 0 then 1 when 1 then 0 end as spinoff
  from lineitem group by l_suppkey, l_shipdate::date)"""
SPARSE_SQL = """sparse as (
  select o_custkey as entity, cast(date_trunc('month', o_orderdate) as date) as month, sum(o_totalprice)::double as amount
  from orders group by 1, 2)"""
ARM_SQL = """arm_ic as (
  select case l_linenumber % 2 when 0 then 'on' else 'off' end as arm, (l_suppkey % 4 + 100)::int as seed, 'fold_0' || (year(l_shipdate) - 1994) as fold,
         cast(date_trunc('month', l_shipdate) as date) as month, ['winner', 'base_a', 'base_c'][(l_partkey % 3 + 1)::int] as predictor,
         corr(l_discount::double, l_tax::double) as ic
  from lineitem where year(l_shipdate) between 1995 and 1999
  group by 1, 2, 3, 4, 5 having min(l_discount) < max(l_discount) and min(l_tax) < max(l_tax))"""
