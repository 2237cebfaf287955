"""Descriptive profiling of panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalpanel.functions.guards import is_missing
from causalpanel.operators.quality import melt
from causalpanel.operators.rank import value_ranks
from causalpanel.session import cut

BANDS = (0.0, 0.01, 0.05, 0.10, 0.20, 0.30, 0.50, 0.75)
DELAYS = (31, 45, 60, 90, 120)
ACCURACY = 10_000


def describe(d: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, mean, sd, least, most, median, skew, kurtosis; missing values are left out.

    The median is an observed value whose rank is off by one in ACCURACY at most.
    """
    long = d.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "feature", "x").where(~is_missing(F.col("x")))
    varies = F.min("x") < F.max("x")
    return long.groupBy("feature").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"),
        F.percentile_approx("x", 0.5, ACCURACY).alias("median"), F.when(varies, F.skewness("x")).alias("skew"), F.when(varies, F.kurtosis("x")).alias("kurtosis"),
    )


def histogram(d: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bucket (0 below, bins + 1 at or above the end), n."""
    return d.where(~is_missing(F.col(column))).groupBy(F.width_bucket(column, F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def missing_bands(d: DataFrame, columns: list[str], bands: tuple[float, ...] = BANDS) -> DataFrame:
    """band (its lower edge), features: half-open bands of missing shares."""
    shares = melt(d, {c: F.avg(is_missing(F.col(c)).cast("double")) for c in columns}, value="share")
    edge = F.lit(None).cast("double")
    for low in bands:
        edge = F.when(F.col("share") >= low, F.lit(low)).otherwise(edge)
    return shares.groupBy(edge.alias("band")).agg(F.count("*").alias("features"))


def gaps(d: DataFrame, entity: str, date: str) -> DataFrame:
    """``d`` with days, the days since the entity's row before."""
    return d.withColumn("days", F.datediff(F.col(date), F.lag(date).over(Window.partitionBy(entity).orderBy(date))))


def reporting_frequency(d: DataFrame, columns: list[str], entity: str, date: str) -> DataFrame:
    """feature, days (the most common gap between values, the least of ties), frequency."""
    long = d.select(entity, date, *columns).unpivot([entity, date], columns, "feature", "x").where(~is_missing(F.col("x")))
    apart = F.datediff(F.col(date), F.lag(date).over(Window.partitionBy("feature", entity).orderBy(date)))
    counted = long.withColumn("days", apart).where("days is not null").groupBy("feature", "days").agg(F.count("*").alias("n"))
    common = counted.groupBy("feature").agg(F.min_by("days", F.struct(-F.col("n"), F.col("days"))).alias("days"))
    return common.withColumn("frequency", F.when(F.col("days") < 45, "monthly").when(F.col("days") < 135, "quarterly").otherwise("annual"))


def attainment(d: DataFrame, delay: str, limits: tuple[int, ...] = DELAYS) -> DataFrame:
    """within (days), share of observed non-negative delays that long at most."""
    seen = d.where(F.col(delay) >= 0)
    made = {str(k): F.avg((F.col(delay) <= k).cast("double")) for k in limits}
    return melt(seen, made, "within", "share").withColumn("within", F.col("within").cast("int"))


def coverage_by_month(frames: dict[str, DataFrame], entity: str, month: str) -> DataFrame:
    """month and the distinct entities of each frame in it, 0 where a frame has none."""
    found = None
    for name, d in frames.items():
        one = d.groupBy(F.trunc(month, "month").alias("month")).agg(F.countDistinct(entity).alias(name))
        found = one if found is None else found.join(one, "month", "full")
    return found.fillna(0, list(frames))


def scope(frames: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """frame, rows, entities, first, last of (frame, entity column, date column)."""
    found = None
    for name, (d, entity, date) in frames.items():
        one = d.agg(F.count("*").alias("rows"), F.countDistinct(entity).alias("entities"), F.min(date).alias("first"), F.max(date).alias("last"))
        one = one.select(F.lit(name).alias("frame"), "*")
        found = one if found is None else found.unionByName(one)
    return found


def company_observations(d: DataFrame, entity: str, date: str) -> DataFrame:
    """entity, rows, first, last, most_gap, years: observation coverage of each entity."""
    return gaps(d, entity, date).groupBy(entity).agg(
        F.count("*").alias("rows"), F.min(date).alias("first"), F.max(date).alias("last"), F.max("days").alias("most_gap"), F.countDistinct(F.year(date)).alias("years")
    )


def cross_section(d: DataFrame, month: str, column: str) -> DataFrame:
    """month, n, mean, sd, median, low, high (5 and 95 percent) of each month's cross-section.

    The three quantiles are the observed values of the exact ranks, ceil(share * n) from below. The ranks
    come from ``value_ranks``, so no task holds a month.
    """
    key = F.struct(F.col(month).alias("month")).alias("_key")  # equal in joins, also for a null month
    d = cut(d.select(key, F.col(column).cast("double").alias("_x")))  # read by the moments and the ranks
    found = d.groupBy("_key").agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"))
    counts = d.where("_x is not null").groupBy("_key", "_x").agg(F.count("*").alias("_m"))
    at = lambda percent: F.min(F.when(100 * (F.col("_below") + F.col("_m")) >= percent * F.col("_all"), F.col("_x")))
    quantiles = value_ranks(counts, ["_key"], "_x", "_m").groupBy("_key").agg(at(50).alias("median"), at(5).alias("low"), at(95).alias("high"))
    return found.join(quantiles, "_key", "left").select("_key.month", "n", "mean", "sd", "median", "low", "high")
