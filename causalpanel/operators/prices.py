"""Price adjustment, outliers and monthly returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalpanel.functions.guards import month_index


def adjust_prices(d: DataFrame, entity: str = "entity", date: str = "p_date", price: str = "p_price") -> DataFrame:
    """``d`` with split_cum, dividend_cum and adj_price (total return).

    Cumulative products run over rows in date order, as sums of logarithms; factors that are not
    positive are skipped. A dividend counts on its day if positive and no spin-off.
    """
    past = Window.partitionBy(entity).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = lambda c: F.sum(F.when(c > 0, F.log(c)).otherwise(0.0)).over(past)
    paid = (F.col("dividend") > 0) & (F.coalesce(F.col("spinoff"), F.lit(0)) == 0) & (F.col(price) != 0)
    factor = F.when(paid, 1 + F.col("dividend") / F.col(price)).otherwise(1.0)
    d = d.withColumns({"split_cum": F.exp(log(F.coalesce("split_factor", F.lit(1.0)))), "dividend_cum": F.exp(log(factor))})
    return d.withColumn("adj_price", F.col(price) / F.col("split_cum") * F.col("dividend_cum"))


def price_join(prices: DataFrame, dividends: DataFrame, splits: DataFrame, identity: list[DataFrame], entity: str = "entity", date: str = "p_date") -> DataFrame:
    """Distinct price rows of entities that every ``identity`` table has, with the day's dividend and split.

    ``identity`` tables join by the columns that they share with what is there. Dividends (by ex_date) and
    splits (by split_date) are optional; several of a day make several rows.
    """
    d = prices
    for one in identity:
        d = d.join(one, [c for c in one.columns if c in d.columns])
    d = d.join(dividends.withColumnRenamed("ex_date", date), [entity, date], "left")
    return d.join(splits.withColumnRenamed("split_date", date), [entity, date], "left").distinct()


def flag_outliers(d: DataFrame, column: str, entity: str, date: str, k: float = 5.0, rows: int = 30) -> DataFrame:
    """``d`` with is_outlier and smoothed: the trailing mean instead of a value beyond k deviations,
    or the previous raw value where that mean is negative. The window includes the row itself."""
    order = Window.partitionBy(entity).orderBy(date)
    window = order.rowsBetween(-rows, 0)
    d = d.withColumns({"_mean": F.avg(column).over(window), "_sd": F.stddev_samp(column).over(window), "_before": F.lag(column).over(order)})
    flag = F.coalesce(F.abs(F.col(column) - F.col("_mean")) > k * F.col("_sd"), F.lit(False))
    better = F.when(F.col("_mean") < 0, F.col("_before")).otherwise(F.col("_mean"))
    return d.withColumns({"is_outlier": flag, "smoothed": F.when(flag, better).otherwise(F.col(column))}).drop("_mean", "_sd", "_before")


def month_end(d: DataFrame, entity: list[str], date: str, price: str) -> DataFrame:
    """(entity..., month, price): the last non-null price of each month."""
    month = F.to_date(F.date_trunc("month", date)).alias("month")
    return d.where(F.col(price).isNotNull()).groupBy(*entity, month).agg(F.max_by(price, date).alias(price))


def monthly_returns(months: DataFrame, price: str, entity: list[str], low: float = -1.0, high: float = 5.0, name: str = "monthly_return") -> DataFrame:
    """Returns from one month to the very next; gaps, zero bases and values out of range go."""
    order = Window.partitionBy(*entity).orderBy("month")
    before = F.when(F.lag(month_index(F.col("month"))).over(order) == month_index(F.col("month")) - 1, F.lag(price).over(order))
    r = months.withColumn(name, F.try_divide(F.col(price), before) - 1)
    return r.where(F.col(name).between(low, high))


def lag_predictors(returns: DataFrame, entity: str = "entity", sector: str = "sector", strict_month: bool = False) -> DataFrame:
    """``returns`` with prev_month_return and prev_month_sector_return.

    The lag goes to the entity's previous row, whatever its month, or with ``strict_month`` to the
    month before only.
    """
    d = returns.withColumn("sector_return", F.avg("monthly_return").over(Window.partitionBy(sector, "month")))
    order = Window.partitionBy(entity).orderBy("month")
    near = (F.lag(month_index(F.col("month"))).over(order) == month_index(F.col("month")) - 1) if strict_month else F.lit(True)
    return d.withColumns({
        "prev_month_return": F.when(near, F.lag("monthly_return").over(order)),
        "prev_month_sector_return": F.when(near, F.lag("sector_return").over(order)),
    }).drop("sector_return")


def industry_returns(returns: DataFrame, sector: str = "sector") -> DataFrame:
    return returns.groupBy(sector, "month").agg(F.avg("monthly_return").alias("industry_return"))
