"""Comparisons between experiment arms over matched seeds, folds and months."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalpanel.operators.rank import ic_summary

KEYS = ["fold", "month"]


def arm(ic: DataFrame, name: str, predictor: str = "winner") -> DataFrame:
    return ic.where((F.col("arm") == name) & (F.col("predictor") == predictor))


def seed_deltas(ic: DataFrame, on: str = "on", off: str = "off", predictor: str = "winner") -> DataFrame:
    """fold, seed, month, on_ic, off_ic, delta: months that both arms have for the seed."""
    a = arm(ic, on, predictor).select("fold", "seed", "month", F.col("ic").alias("on_ic"))
    b = arm(ic, off, predictor).select("fold", "seed", "month", F.col("ic").alias("off_ic"))
    return a.join(b, ["fold", "seed", "month"]).withColumn("delta", F.col("on_ic") - F.col("off_ic"))


def seed_averaged(ic: DataFrame, on: str = "on", off: str = "off", predictor: str = "winner") -> DataFrame:
    """fold, month, on_ic, off_ic, delta: means over the seeds matched in each month."""
    d = seed_deltas(ic, on, off, predictor).groupBy(*KEYS)
    return d.agg(F.avg("on_ic").alias("on_ic"), F.avg("off_ic").alias("off_ic"), F.avg("delta").alias("delta"))


def within_arm(ic: DataFrame, name: str, predictors: list[str]) -> DataFrame:
    """fold, month and a column per predictor: means over the seeds that have all of them that month."""
    d = ic.where((F.col("arm") == name) & F.col("predictor").isin(*predictors))
    wide = d.groupBy("fold", "seed", "month").pivot("predictor", predictors).agg(F.avg("ic")).na.drop(subset=predictors)
    return wide.groupBy(*KEYS).agg(*[F.avg(p).alias(p) for p in predictors])


def lifts(ic: DataFrame, base: str, on: str = "on", off: str = "off", winner: str = "winner") -> DataFrame:
    """fold, month, on_lift, off_lift, difference: winner less baseline in each arm, months of both."""
    one = lambda name, alias: within_arm(ic, name, [winner, base]).select(*KEYS, (F.col(winner) - F.col(base)).alias(alias))
    return one(on, "on_lift").join(one(off, "off_lift"), KEYS).withColumn("difference", F.col("on_lift") - F.col("off_lift"))


def seed_levels(ic: DataFrame, predictor: str = "winner", by_fold: bool = False) -> DataFrame:
    """arm, seed (, fold): mean IC and IC-IR, unmatched."""
    keys = ["arm", "seed", "fold"] if by_fold else ["arm", "seed"]
    return ic.where(F.col("predictor") == predictor).groupBy(*keys).agg(*ic_summary(F.col("ic")))


def holm(d: DataFrame, p: str = "p_value", order: str = "position", family: tuple[str, ...] = ()) -> DataFrame:
    """``d`` with adjusted: Holm's step-down within the family, ties in input order."""
    ranked = Window.partitionBy(*family).orderBy(p, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*family))
    scaled = d.withColumn("_s", (n - F.row_number().over(ranked) + 1) * F.col(p))
    return scaled.withColumn("adjusted", F.least(F.lit(1.0), F.max("_s").over(ranked.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def with_mean_row(d: DataFrame, label: str, name: str = "mean") -> DataFrame:
    """``d`` and a row of the means of its numeric columns."""
    means = [F.avg(c).alias(c) if t in ("double", "int", "bigint", "float") else F.lit(name).alias(c) if c == label else F.lit(None).cast(t).alias(c) for c, t in d.dtypes]
    return d.unionByName(d.agg(*means))


def family_usage(winners: DataFrame, families: str = "families") -> DataFrame:
    """family, winners, percent: how many winners use each operator family."""
    total = winners.agg(F.count("*")).scalar()
    d = winners.select(F.explode(F.array_distinct(families)).alias("family")).groupBy("family").agg(F.count("*").alias("winners"))
    return d.withColumn("percent", 100.0 * F.col("winners") / total)


def stability(runs: DataFrame) -> DataFrame:
    """One row from (run, winner, top (array), rmse, mean_ic): modal share, mean pairwise Jaccard, spreads.

    The modal winner is the least of the most frequent; one run overlaps itself fully.
    """
    counts = runs.groupBy("winner").agg(F.count("*").alias("n"))
    modal = counts.agg(F.min_by("winner", F.struct(-F.col("n"), F.col("winner"))).alias("modal_winner"), (F.max("n") / F.sum("n")).alias("champion_stability"))
    a = runs.select(F.col("run").alias("r1"), F.col("top").alias("t1"))
    b = runs.select(F.col("run").alias("r2"), F.col("top").alias("t2"))
    union = F.size(F.array_union("t1", "t2"))
    pairs = a.join(b, F.col("r1") < F.col("r2")).select(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("t1", "t2")) / union).alias("j"))
    overlap = pairs.agg(F.coalesce(F.avg("j"), F.lit(1.0)).alias("top_k_overlap"))
    spread = lambda c: [F.when(F.count(c) >= 2, F.stddev_pop(c)).alias(f"{c}_std"), (F.max(c) - F.min(c)).alias(f"{c}_range")]
    rest = runs.agg(F.count("*").alias("n_runs"), *spread("rmse"), *spread("mean_ic"))
    return rest.join(modal).join(overlap)  # three tables of one row


def verdict(d: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``d`` (delta, lower_bound, p_value, insufficient) with verdict."""
    good = (F.col("delta") > 0) & (F.col("lower_bound") > 0) & (F.col("p_value") < alpha)
    return d.withColumn("verdict", F.when(F.col("insufficient"), "PENDING").when(good, "SUPPORTED").otherwise("NOT SUPPORTED"))
