"""Consensus feature selection."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causalpanel.operators import model, quality
from causalpanel.operators.rank import percentile_rank, spearman

LEAST_PERCENTILE, LEAST_VOTES, CUT = 0.60, 2, 0.20


def consensus(scores: DataFrame, least: float = LEAST_PERCENTILE, votes: int = LEAST_VOTES) -> DataFrame:
    """(feature, method, score) -> feature, votes, consensus_score, kept.

    A method votes for a feature whose percentile is ``least`` or more; the consensus score is the
    mean of the percentiles there are.
    """
    d = scores.where("score is not null").withColumn("_p", percentile_rank(F.col("score"), ["method"]))
    found = d.groupBy("feature").agg(F.count_if(F.col("_p") >= least).alias("votes"), F.avg("_p").alias("consensus_score"))
    return found.withColumn("kept", F.col("votes") >= votes)


def average_linkage(names: list[str], distance: np.ndarray, cut: float = CUT) -> dict[str, int]:
    """Cluster numbers by average linkage, merging while the closest pair is within ``cut``.

    ``distance`` is over features, a matrix that fits the driver; NaN counts as far.
    """
    d = np.where(np.isnan(distance), np.inf, distance).astype(float)
    np.fill_diagonal(d, np.inf)
    members = {k: [k] for k in range(len(names))}
    while len(members) > 1:
        i, j = sorted(int(x) for x in np.unravel_index(np.argmin(d), d.shape))
        if not d[i, j] <= cut:
            break
        a, b = len(members[i]), len(members[j])
        d[i] = d[:, i] = (a * d[i] + b * d[j]) / (a + b)
        d[j] = d[:, j] = np.inf
        d[i, i] = np.inf
        members[i] += members.pop(j)
    return {names[k]: n for n, group in enumerate(sorted(members.values(), key=min)) for k in group}


def representatives(d: DataFrame) -> DataFrame:
    """One feature per cluster: by score, missingness, company and sector coverage, rank score, name."""
    order = [F.desc("consensus_score"), F.col("missing_share"), F.desc("company_coverage"), F.desc("sector_coverage"), F.desc("spearman"), F.col("feature")]
    return d.withColumn("_n", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).where("_n = 1").drop("_n")


def terminal_cap(d: DataFrame, most: int | None) -> DataFrame:
    order = [F.desc("consensus_score"), F.col("feature")]
    return d if most is None else d.orderBy(*order).limit(most)


def greedy_uncorrelated(scores: list[tuple[str, float]], correlation: dict[tuple[str, str], float], most: float = 0.8) -> list[str]:
    """Features in order of score, each kept unless it correlates beyond ``most`` with a kept one."""
    kept: list[str] = []
    for name, _ in sorted(scores, key=lambda x: (-x[1], x[0])):
        if all(abs(correlation.get((name, k), correlation.get((k, name), 0.0)) or 0.0) <= most for k in kept):
            kept.append(name)
    return kept


def bottom_fraction(scores: DataFrame, share: float = 0.10) -> DataFrame:
    """(feature, score) -> with flagged: the weakest ``share`` of the features, by absolute score, then name."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    order = Window.orderBy(F.coalesce(F.abs("score"), F.lit(-1.0)), "feature")  # a row per feature
    return scores.withColumn("flagged", F.row_number().over(order) <= F.floor(n * share))


def legacy_select(
    train: DataFrame, columns: list[str], target: str, share: float = 0.10, most: float = 0.8, count: int | None = None, trees: int = 100, repeats: int = 5, seed: int = 0,
) -> dict[str, list[str]]:
    """The earlier selector: weak, uninformative, correlated and unimportant features leave, in this order.

    The weakest ``share`` by Pearson or by rank correlation goes, then by mutual information; of pairs that
    correlate beyond ``most`` the one of less information goes; the forest's ``count`` most important stay.
    Names by step; only tables with a row per feature or pair reach the driver.
    """
    weak = set()
    scores = [quality.pearson(train, columns, target).withColumnRenamed("correlation", "score"), model.spearman_scores(train, columns, target)]
    for d in scores:
        all_ = train.sparkSession.createDataFrame([(c,) for c in columns], "feature string").join(d, "feature", "left")
        weak |= {r["feature"] for r in bottom_fraction(all_, share).where("flagged").collect()}
    strong = [c for c in columns if c not in weak]
    told = {r["feature"]: r["score"] for r in model.mutual_information(train, strong, target).collect()} if strong else {}
    dull = set(sorted(strong, key=lambda c: (told.get(c, 0.0), c))[: int(len(strong) * share)])
    strong = [c for c in strong if c not in dull]
    rho = {(r["a"], r["b"]): r["rho"] for r in spearman(train.fillna(0, strong), list(combinations(strong, 2)), 2).collect()} if len(strong) > 1 else {}
    apart = greedy_uncorrelated([(c, told.get(c, 0.0)) for c in strong], rho, most)
    worth = {r["feature"]: r["score"] for r in model.permutation_importance(train, apart, target, trees, repeats, seed).collect()} if apart else {}
    kept = sorted(apart, key=lambda c: (-worth.get(c, 0.0), c))[:count]
    return {"weak": sorted(weak), "uninformative": sorted(dull), "correlated": sorted(set(strong) - set(apart)), "selected": kept}


def select_features(
    train: DataFrame, columns: list[str], target: str, entity: str, sector: str, most: int | None = None, trees: int = 100, repeats: int = 5, seed: int = 0, cut: float = CUT,
) -> dict[str, DataFrame]:
    """The consensus tables of one fold, from its training rows: scores, consensus, clusters, selected, rejected.

    Three scores vote; what two of them keep is clustered by rank correlation; each cluster gives its
    representative; a cap may follow. ``rejected`` says at which stage a feature left. Only tables with
    a row per feature or pair of features reach the driver.
    """
    spark = train.sparkSession
    scored = {
        "spearman": model.spearman_scores(train, columns, target),
        "mutual": model.mutual_information(train, columns, target),
        "forest": model.permutation_importance(train, columns, target, trees, repeats, seed),
    }
    scores = None
    for method, d in scored.items():
        one = d.select("feature", F.lit(method).alias("method"), "score")
        scores = one if scores is None else scores.unionByName(one)
    scores = scores.persist()
    votes = consensus(scores)
    kept = sorted(r["feature"] for r in votes.where("kept").collect())
    filled = train.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in kept])
    distance = np.ones((len(kept), len(kept)))
    for r in spearman(filled, list(combinations(kept, 2)), 2).collect() if len(kept) > 1 else []:
        i, j = kept.index(r["a"]), kept.index(r["b"])
        distance[i, j] = distance[j, i] = np.nan if r["rho"] is None else 1 - abs(r["rho"])
    numbers = average_linkage(kept, distance, cut) if kept else {}
    clusters = spark.createDataFrame(list(numbers.items()), "feature string, cluster int")
    facts = quality.missing_shares(train, columns).join(quality.coverage(train, columns, entity).withColumnRenamed("covered", "company_coverage"), "feature")
    facts = facts.join(quality.coverage(train, columns, sector).withColumnRenamed("covered", "sector_coverage"), "feature")
    ranks = scores.withColumn("spearman", percentile_rank(F.col("score"), ["method"])).where("method = 'spearman'").select("feature", "spearman")
    chosen = representatives(clusters.join(votes, "feature").join(facts, "feature").join(ranks, "feature", "left"))
    selected = terminal_cap(chosen, most)
    left = spark.createDataFrame([(c,) for c in columns], "feature string").join(selected.select("feature"), "feature", "left_anti")
    told = left.join(votes, "feature", "left").join(clusters, "feature", "left").join(chosen.select("feature", F.lit(True).alias("_chosen")), "feature", "left")
    stage = F.when(F.col("votes").isNull(), "unscored").when(~F.col("kept"), "consensus").when(F.col("_chosen").isNull(), "cluster").otherwise("cap")
    return {"scores": scores, "consensus": votes, "clusters": clusters, "selected": selected, "rejected": told.select("feature", stage.alias("stage"))}
