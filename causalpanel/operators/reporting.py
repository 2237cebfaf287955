"""Tables that sum up runs, sweeps and panels. Inputs have a row per fold, generation or expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalpanel.operators.compare import with_mean_row
from causalpanel.operators.quality import infinity_counts, missing_shares
from causalpanel.operators.rank import ic_summary

METRICS = ["rmse", "mean_ic", "ic_ir"]


def run_means(results: DataFrame, by: str = "run") -> DataFrame:
    """run, folds and the mean of each metric over its folds; a fold without a value does not count."""
    return results.groupBy(by).agg(F.count("*").alias("folds"), *[F.avg(m).alias(m) for m in METRICS])


def fold_summary(ic: DataFrame, predictor: str = "winner") -> DataFrame:
    """arm, fold, seeds, months, mean_ic, ic_ir of seed-averaged months, and a row of means for each arm."""
    d = ic.where(F.col("predictor") == predictor)
    months = d.groupBy("arm", "fold", "month").agg(F.avg("ic").alias("ic"))
    found = months.groupBy("arm", "fold").agg(*ic_summary(F.col("ic"))).join(d.groupBy("arm", "fold").agg(F.countDistinct("seed").alias("seeds")), ["arm", "fold"])
    means = found.groupBy("arm").agg(F.lit("mean").alias("fold"), F.avg("mean_ic").alias("mean_ic"), F.avg("ic_ir").alias("ic_ir"), F.sum("months").alias("months"), F.max("seeds").alias("seeds"))
    return found.unionByName(means)


def sweep_table(results: DataFrame, setting: str, metric: str = "mean_ic", arm: str = "arm") -> DataFrame:
    """setting, a column per arm, objective (the mean of the arms), best: one row per value of a setting.

    The best value has the largest objective; of equals the least. A value that an arm lacks has none.
    """
    per = results.groupBy(setting, arm).agg(F.avg(metric).alias("_m"))
    wide = per.groupBy(setting).pivot(arm, ["on", "off"]).agg(F.first("_m"))
    wide = wide.withColumn("objective", (F.col("on") + F.col("off")) / 2)
    order = Window.orderBy(F.desc_nulls_last("objective"), setting)  # a row per value of the setting
    return wide.withColumn("best", F.col("objective").isNotNull() & (F.row_number().over(order) == 1))


def history(generations: DataFrame) -> DataFrame:
    """(run, generation, best, diversity) -> with so_far, gain and stale (generations since the last gain)."""
    past = Window.partitionBy("run").orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("run").orderBy("generation").rowsBetween(Window.unboundedPreceding, -1)
    d = generations.withColumns({"so_far": F.max("best").over(past), "_before": F.max("best").over(before)})
    d = d.withColumn("gain", F.greatest(F.col("so_far") - F.col("_before"), F.lit(0.0)))
    last = F.max(F.when(F.col("_before").isNull() | (F.col("gain") > 0), F.col("generation"))).over(past)
    return d.withColumn("stale", F.col("generation") - last).drop("_before")


def composition(winners: DataFrame) -> DataFrame:
    """(fold, arm, leaves, depth) -> fold, on_/off_ columns, their differences, and a row of means."""
    one = lambda arm: winners.where(F.col("arm") == arm).select("fold", *[F.col(c).cast("double").alias(f"{arm}_{c}") for c in ("leaves", "depth")])
    d = one("on").join(one("off"), "fold")
    d = d.withColumns({f"{c}_delta": F.col(f"on_{c}") - F.col(f"off_{c}") for c in ("leaves", "depth")})
    return with_mean_row(d, "fold")


def snapshot(d: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature, missing_share, infinities for every column, with the target's n, mean, sd, least and most."""
    x = F.col(target).cast("double")
    facts = d.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most"))
    return missing_shares(d, columns).join(infinity_counts(d, columns), "feature").join(F.broadcast(facts))  # one row


def threshold_counts(pairs: DataFrame, limits: tuple[float, ...] = (0.5, 0.7, 0.8, 0.9, 0.95), rho: str = "rho") -> DataFrame:
    """threshold, pairs: how many pairs correlate that strongly, in absolute value, or more."""
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.coalesce((F.abs(rho) >= t).cast("int"), F.lit(0)).alias("hit")) for t in limits]))
    return pairs.select(rows.alias("r")).groupBy("r.threshold").agg(F.sum("r.hit").alias("pairs"))


def master(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: the columns of tables of one row each, named table_column."""
    found = None
    for name, d in tables.items():
        one = d.select([F.col(c).alias(f"{name}_{c}") for c in d.columns])
        found = one if found is None else found.join(F.broadcast(one))  # one row each
    return found
