"""Boosted-tree fits and feature scores on Spark ML."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalpanel.functions.guards import is_missing
from causalpanel.operators.rank import rmse, spearman, value_ranks
from causalpanel.session import cut

#: Rows that a column is shuffled among.
BUCKET = 4096


def fit_predict(train: DataFrame, test: DataFrame, inputs: list[str], label: str, keys: list[str], trees: int = 85, depth: int = 5, seed: int = 0) -> DataFrame:
    """``test`` rows without missing inputs, with ``prediction``. Rows are dealt by ``keys`` for repeatable fits."""
    sound = lambda d: d.na.drop(subset=[*inputs, label])
    vector = VectorAssembler(inputCols=inputs, outputCol="_features")
    model = GBTRegressor(featuresCol="_features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed)
    fitted = model.fit(vector.transform(sound(train).repartition(*keys).sortWithinPartitions(*keys)).select("_features", label))
    return fitted.transform(vector.transform(sound(test))).drop("_features")


def errors(predictions: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    return predictions.groupBy(*by).agg(rmse(F.col(label), F.col("prediction")).alias("rmse"), F.count("*").alias("n"))


def spearman_scores(d: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature, score: absolute rank correlation with the target, missing values as 0; no constants."""
    filled = d.select(target, *[F.coalesce(F.when(~is_missing(F.col(c)), F.col(c)), F.lit(0.0)).alias(c) for c in columns])
    return spearman(filled, [(c, target) for c in columns], 2).select(F.col("a").alias("feature"), F.abs("rho").alias("score")).where("score is not null")


def mutual_information(d: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """feature, score: mutual information of quantile bins (nats), missing values as 0.

    A binned estimate; it orders features but does not equal nearest-neighbour estimates. A value's bin
    follows from how many rows are below it (``value_ranks``), so equal values share one.
    """
    filled = d.select(F.col(target).cast("double").alias("_y"), *[F.coalesce(F.when(~is_missing(F.col(c)), F.col(c)), F.lit(0.0)).cast("double").alias(c) for c in columns])
    cells = cut(filled.unpivot(["_y"], columns, "feature", "x").groupBy("feature", "x", "_y").agg(F.count("*").alias("_n")))
    for c, name in (("x", "a"), ("_y", "b")):
        ranked = value_ranks(cells.groupBy("feature", c).agg(F.sum("_n").alias("_m")), ["feature"], c, "_m")
        bin_ = F.least(F.floor(F.col("_below") * bins / F.col("_all")), F.lit(bins - 1))
        cells = cells.join(ranked.select("feature", c, bin_.alias(name)), ["feature", c])
    cells = cells.groupBy("feature", "a", "b").agg(F.sum("_n").alias("n"))
    of = lambda *k: F.sum("n").over(Window.partitionBy("feature", *k))  # noqa: E731  bins * bins rows a feature
    cells = cells.withColumn("_p", F.col("n") / of() * F.log(F.col("n") * of() / (of("a") * of("b"))))
    return cells.groupBy("feature").agg(F.greatest(F.sum("_p"), F.lit(0.0)).alias("score"))


def permutation_importance(d: DataFrame, columns: list[str], target: str, trees: int = 100, repeats: int = 5, seed: int = 0) -> DataFrame:
    """feature, score: mean loss of R² of a random forest when a column is shuffled.

    A repeat deals the rows to buckets of about BUCKET by a seeded hash of their content; within a bucket
    each column in turn goes around by one place in an order of its own. One pass a repeat, no global order.
    """
    filled = d.select(F.col(target).cast("double").alias("_y"), *[F.coalesce(F.when(~is_missing(F.col(c)), F.col(c)), F.lit(0.0)).cast("double").alias(c) for c in columns])
    filled = filled.where(~is_missing(F.col("_y"))).withColumn("_id", F.xxhash64("_y", *columns)).persist()
    vector = lambda parts: array_to_vector(F.array(*parts))
    plain = [F.col(c) for c in columns]
    model = RandomForestRegressor(featuresCol="_features", labelCol="_y", numTrees=trees, seed=seed).fit(filled.select("_y", vector(plain).alias("_features")))
    error = F.avg((F.col("_y") - F.col("prediction")) ** 2)
    facts = model.transform(filled.select("_y", vector(plain).alias("_features"))).agg(error.alias("base"), F.var_pop("_y").alias("spread"), F.count("*").alias("n")).first()
    buckets = max(1, math.ceil((facts["n"] or 0) / BUCKET))
    found = None
    for r in range(repeats):
        moved = filled.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "_id"), F.lit(buckets)))
        for c in columns:
            around = Window.partitionBy("_bucket").orderBy(F.xxhash64(F.lit(f"{seed}:{c}:{r}"), "_id"))
            first = F.first(c).over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            moved = moved.withColumn(f"_moved_{c}", F.coalesce(F.lead(c).over(around), first))
        each = [F.struct(F.lit(c).alias("feature"), vector([F.col(f"_moved_{k}") if k == c else F.col(k) for k in columns]).alias("_features")) for c in columns]
        one = moved.select("_y", F.explode(F.array(*each)).alias("_e")).select("_y", "_e.*")
        one = model.transform(one).groupBy("feature").agg(error.alias("_error"))
        found = one if found is None else found.unionByName(one)
    rows = found.groupBy("feature").agg(F.avg("_error").alias("e")).collect()  # a row per column
    filled.unpersist()
    spread = facts["spread"] or 1.0
    return d.sparkSession.createDataFrame([(r["feature"], float((r["e"] - facts["base"]) / spread)) for r in rows], "feature string, score double")
