"""Moving-block bootstraps. Only the draws come from the driver's generator; the rest is joins."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK, REPLICATES, SEED, LEAST_FOLDS = 3, 3000, 42, 5


def draw_starts(spark: SparkSession, lengths: dict[str, int], block: int = BLOCK, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """rep, fold, part, start: the first position of each block, by replicate, fold and block."""
    rng, rows = random.Random(seed), []
    for rep in range(replicates):
        for fold, n in lengths.items():
            if n <= block:
                rows.append((rep, fold, 0, 0))
                continue
            rows.extend((rep, fold, part, rng.randint(0, n - block)) for part in range(math.ceil(n / block)))
    return spark.createDataFrame(rows, "rep int, fold string, part int, start int")


def bootstrap(deltas: DataFrame, starts: DataFrame, block: int = BLOCK, least_folds: int = LEAST_FOLDS, value: str = "delta") -> DataFrame:
    """One row: observed, lower_bound, p_value, replicates, insufficient.

    ``deltas`` (fold, month, value). Blocks of ``block`` months are laid end to end and cut at each
    fold's length; a replicate is the mean over all folds' months. The null is centred by reflection:
    the lower bound is twice the observed mean less the 95th percentile, p the share of replicates
    of twice the observed mean or more. NULL for fewer than ``least_folds`` folds.
    """
    placed = deltas.withColumn("_at", F.row_number().over(Window.partitionBy("fold").orderBy("month")) - 1)
    lengths = placed.groupBy("fold").agg(F.count("*").alias("_n"))
    steps = F.when(F.col("_n") <= block, F.col("_n")).otherwise(F.lit(block))
    laid = starts.join(lengths, "fold").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)))
    laid = laid.where(F.col("part") * block + F.col("_k") < F.col("_n")).select("rep", "fold", (F.col("start") + F.col("_k")).alias("_at"))
    means = laid.join(placed.select("fold", "_at", value), ["fold", "_at"]).groupBy("rep").agg(F.avg(value).alias("_m"))
    seen = deltas.agg(F.avg(value).alias("observed"), F.countDistinct("fold").alias("_folds"))
    enough = F.first("_folds") >= least_folds
    both = means.join(F.broadcast(seen))  # one row
    return both.agg(
        F.first("observed").alias("observed"),
        F.when(enough, 2 * F.first("observed") - F.percentile("_m", 0.95)).alias("lower_bound"),
        F.when(enough, F.avg((F.col("_m") >= 2 * F.col("observed")).cast("double"))).alias("p_value"),
        F.count("*").cast("int").alias("replicates"), (~enough).alias("insufficient"),
    )


def draw_seeds(spark: SparkSession, seeds: list[int], replicates: int, seed: int = SEED) -> DataFrame:
    """rep, seed, times: the seeds of each replicate, drawn with replacement."""
    rng, rows = random.Random(seed), []
    for rep in range(replicates):
        drawn = [rng.choice(seeds) for _ in seeds]
        rows += [(rep, s, drawn.count(s)) for s in dict.fromkeys(drawn)]
    return spark.createDataFrame(rows, "rep int, seed int, times int")


def seed_bootstrap(deltas: DataFrame, drawn: DataFrame, starts: DataFrame, block: int = BLOCK, least_folds: int = LEAST_FOLDS) -> DataFrame:
    """As ``bootstrap`` over (fold, seed, month, delta), each replicate averaging its own draw of seeds."""
    averaged = deltas.join(drawn, "seed").groupBy("rep", "fold", "month")
    averaged = averaged.agg((F.sum(F.col("delta") * F.col("times")) / F.sum("times")).alias("_v"))
    placed = averaged.withColumn("_at", F.row_number().over(Window.partitionBy("rep", "fold").orderBy("month")) - 1)
    lengths = placed.groupBy("rep", "fold").agg(F.count("*").alias("_n"))
    laid = starts.join(lengths, ["rep", "fold"]).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_n"), F.lit(block)) - 1)))
    laid = laid.where(F.col("part") * block + F.col("_k") < F.col("_n")).select("rep", "fold", (F.col("start") + F.col("_k")).alias("_at"))
    means = laid.join(placed, ["rep", "fold", "_at"]).groupBy("rep").agg(F.avg("_v").alias("_m"))
    plain = deltas.groupBy("fold", "month").agg(F.avg("delta").alias("delta"))
    seen = plain.agg(F.avg("delta").alias("observed"), F.countDistinct("fold").alias("_folds"))
    enough = F.first("_folds") >= least_folds
    return means.join(F.broadcast(seen)).agg(
        F.first("observed").alias("observed"), F.when(enough, 2 * F.first("observed") - F.percentile("_m", 0.95)).alias("lower_bound"),
        F.when(enough, F.avg((F.col("_m") >= 2 * F.col("observed")).cast("double"))).alias("p_value"), F.count("*").cast("int").alias("replicates"),
    )
