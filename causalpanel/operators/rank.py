"""Month-wise rank correlation and the summaries of such series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalpanel.functions.guards import average_rank, is_missing, safe_corr
from causalpanel.session import cut

#: Ranges that the values of one column are cut into for their ranks.
RANGES = 64


def monthly_rank_ic(d: DataFrame, month: str = "month", label: str = "label", prediction: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., month, ic, n): Spearman of each month; months of one pair or a constant side are left out."""
    keys = [*by, month]
    d = d.where(~is_missing(F.col(label)) & ~is_missing(F.col(prediction)))
    d = d.withColumns({"_x": average_rank(F.col(prediction), keys), "_y": average_rank(F.col(label), keys)})
    found = d.groupBy(*keys).agg(safe_corr(F.col("_x"), F.col("_y")).alias("ic"), F.count("*").alias("n"))
    return found.where("ic is not null")


def value_ranks(counts: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """(by..., value, n) rows of distinct values -> with _below, how many rows have a smaller value, and _all.

    Values are cut into RANGES ranges at approximate quantiles; ranges get their offsets from sums, and
    only values of one range meet in a window: no task holds all values of a group, and a value that
    many rows share is one row. ``by`` has a few groups (columns, pairs): their cuts are broadcast.
    """
    shares = [k / RANGES for k in range(1, RANGES)]
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, shares, 10 * RANGES).alias("_cuts"))
    d = counts.join(F.broadcast(cuts), by)
    d = d.withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = d.groupBy(*by, "_range").agg(F.sum(n).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"), F.sum("_sum").over(Window.partitionBy(*by)).alias("_all"))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    d = d.join(F.broadcast(totals), [*by, "_range"])
    return d.select(*by, value, n, (F.col("_offset") + F.col("_before")).alias("_below"), "_all")


def spearman(d: DataFrame, pairs: list[tuple[str, str]], least: int = 10) -> DataFrame:
    """a, b, rho, n over the rows where both have values; rho NULL for fewer than ``least`` pairs.

    Rows become counts of (x, y) first; each side's values are ranked among all (``value_ranks``), ties
    sharing their mean rank, and the correlation of the ranks is a weighted sum over the counts.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(a).cast("double") + 0.0).alias("x"), (F.col(b).cast("double") + 0.0).alias("y")) for a, b in pairs]))
    long = d.select(rows.alias("r")).select("r.*").where(~is_missing(F.col("x")) & ~is_missing(F.col("y")))
    cells = cut(long.groupBy("a", "b", "x", "y").agg(F.count("*").alias("_n")))  # read by both sides
    for c in ("x", "y"):
        ranked = value_ranks(cells.groupBy("a", "b", c).agg(F.sum("_n").alias("_m")), ["a", "b"], c, "_m")
        centred = F.col("_below") + F.col("_m") / 2.0 - F.col("_all") / 2.0  # the mean rank less the mean of all
        cells = cells.join(ranked.select("a", "b", c, centred.alias(f"_{c}")), ["a", "b", c])
    total = lambda u, v: F.sum(F.col(u) * F.col(v) * F.col("_n"))
    rho = F.try_divide(total("_x", "_y"), F.sqrt(total("_x", "_x")) * F.sqrt(total("_y", "_y")))
    found = cells.groupBy("a", "b").agg(rho.alias("rho"), F.sum("_n").alias("n"))
    return found.withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))


def spearman_matrix(d: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, rho for every ordered pair of columns, missing values as 0; 1 on the diagonal, NULL for constants."""
    from itertools import combinations

    filled = d.select(*[F.coalesce(F.when(~is_missing(F.col(c)), F.col(c)), F.lit(0.0)).alias(c) for c in columns])
    half = spearman(filled, list(combinations(columns, 2)), 2).select("a", "b", "rho")
    one = d.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "a string, b string, rho double")
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "rho")).unionByName(one)


def ic_summary(x: Column) -> list[Column]:
    """mean_ic, ic_ir (mean over sample deviation, NULL if undefined), months."""
    return [F.avg(x).alias("mean_ic"), F.try_divide(F.avg(x), F.stddev_samp(x)).alias("ic_ir"), F.count(x).alias("months")]


def rmse(label: Column, prediction: Column) -> Column:
    return F.sqrt(F.avg((label - prediction) * (label - prediction)))


def percentile_rank(c: Column, by: list[str]) -> Column:
    """Average rank over the number of values, within ``by``."""
    return average_rank(c, by) / F.count(c).over(Window.partitionBy(*by))
