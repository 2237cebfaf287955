"""From irregular reports to a monthly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand_reports(reports: DataFrame, available: str, period: str, last_month, entity: str = "entity") -> DataFrame:
    """A row per report and target month in which it is the latest known one.

    A report counts from the first of the month after it became available until the month in which
    its successor (by period) does, or through ``last_month`` (a date or a column). Where reports
    overlap, the latest period wins.
    """
    following = F.lead(available).over(Window.partitionBy(entity).orderBy(period))
    cutoff = F.lit(last_month) if not hasattr(last_month, "isNull") else last_month
    month_after = lambda c: F.add_months(F.trunc(c, "month"), 1)
    d = reports.withColumn("_next", following).withColumn("_from", month_after(F.col(available)))
    d = d.withColumn("_to", F.coalesce(F.date_sub(month_after(F.col("_next")), 1), F.last_day(cutoff))).where("_from <= _to")
    d = d.withColumn("target_date", F.explode(F.expr("sequence(_from, _to, interval 1 month)"))).drop("_next", "_from", "_to")
    latest = Window.partitionBy(entity, "target_date").orderBy(F.desc(period))
    return d.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def join_panel(expanded: DataFrame, returns: DataFrame, entity: str = "entity", target: str = "monthly_return") -> DataFrame:
    """The base panel: expanded reports with the same month's return and lag predictors."""
    r = returns.where(F.col(target).isNotNull()).withColumnRenamed("month", "target_date")
    extra = [c for c in r.columns if c in expanded.columns and c not in (entity, "target_date")]
    return expanded.join(r.drop(*extra), [entity, "target_date"])
