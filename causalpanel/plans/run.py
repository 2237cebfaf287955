"""Whole runs: every fold searched, held against its baselines, exported, and skipped if it is done."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict, replace
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalpanel.operators.model import errors
from causalpanel.operators.rank import ic_summary, monthly_rank_ic
from causalpanel.plans import expr, folds, search
from causalpanel.plans.folds import Fold
from causalpanel.sources import io


def measured(p: DataFrame, scorer: search.PanelScorer) -> dict:
    """rmse, mean_ic, ic_ir, months and n of held-out predictions of one model."""
    ic = monthly_rank_ic(p, scorer.month, scorer.target).agg(*ic_summary(F.col("ic"))).first().asDict()
    return errors(p, scorer.target).first().asDict() | ic


def run_fold(panel: DataFrame, fold: Fold, features: list[str], grammar: expr.Grammar, settings: search.Settings, seed: int, root: str, random_draws: int | None = None, embargo: int = 1, **scoring) -> dict:
    """One fold's result, from ``root`` if it is there for the same inputs, else computed and stored.

    A final fold is searched on its validation window, a development fold on its test window; the winner
    is fitted once more for the true test window. Beside it stand the two fixed predictors and as many random
    forms as the search has scored (or ``random_draws``). Predictions of all three are a table.
    """
    spark = panel.sparkSession
    config = {"settings": asdict(settings), "seed": seed, "embargo": embargo, "random_draws": random_draws, **scoring}
    mark = folds.fingerprint(features, fold, config)
    place = f"{root}/{fold.category}/{fold.name}"
    done = io.load_json(spark, f"{place}/fold_result.json", mark)
    if done:
        return done
    d = folds.split(panel, fold, scoring.get("month", "target_date"), embargo)
    inner = search.PanelScorer(d, features, on="validation" if fold.validation else "test", **scoring)
    state = io.load_json(spark, f"{place}/state.json", mark)
    save = lambda s: io.save_json(spark, f"{place}/state.json", search.to_json(s) | {"fingerprint": mark})
    best, state, known = search.search(inner, grammar, settings, folds.derive_seed(seed, fold.category, fold.name), search.from_json(state) if state else None, save)
    drawn, _ = search.random_search(inner, grammar, random_draws or len(known), folds.derive_seed(seed, fold.name))
    inner.release()
    outer = search.PanelScorer(d.where(F.col("split").isin("train", "test")), features, **scoring)
    p, held = outer.held_out([best, drawn])
    named = F.when(F.col("model") == "0", "winner").otherwise("base_c")
    p = p.withColumn("model", named).unionByName(search.baseline_predictions(outer.panel, outer).withColumn("model", F.lit("base_a")))
    p = io.checkpoint_table(p, f"{place}/predictions")
    held.unpersist()
    outer.release()
    result = {"fingerprint": mark, "fold": fold.name, "category": fold.category, "seed": seed, "winner": str(best), "random": str(drawn), "generations": len(state.best), "scored": len(known), "fitness": known[best]}
    result |= {name: measured(p.where(F.col("model") == name), outer) for name in ("winner", "base_a", "base_c")}
    io.save_json(spark, f"{place}/fold_result.json", result)
    return result


def run(panel: DataFrame, wanted: list[Fold], features: list[str], grammar: expr.Grammar, settings: search.Settings, seed: int, root: str, **options) -> DataFrame:
    """All folds one after the other; run, fold, category, predictor, rmse, mean_ic, ic_ir, months, n as a table."""
    rows = []
    for fold in wanted:
        r = run_fold(panel, fold, features, grammar, settings, seed, root, **options)
        rows += [(root, fold.name, fold.category, name, *[r[name][c] for c in ("rmse", "mean_ic", "ic_ir", "months", "n")]) for name in ("winner", "base_a", "base_c")]
    d = panel.sparkSession.createDataFrame(rows, "run string, fold string, category string, predictor string, rmse double, mean_ic double, ic_ir double, months long, n long")
    return io.checkpoint_table(d, f"{root}/summary")


def trials(grid: dict[str, list], settings: search.Settings) -> Iterator[tuple[dict, search.Settings]]:
    """Every combination of the grid's values, with the settings that it makes."""
    for values in product(*grid.values()):
        chosen = dict(zip(grid, values, strict=True))
        yield chosen, replace(settings, **{k: v for k, v in chosen.items() if hasattr(settings, k)})


def sweep(objective: Callable[[dict, search.Settings, str], float | None], grid: dict[str, list], settings: search.Settings, arms: tuple[str, ...] = ("on", "off")) -> list[dict]:
    """A row per combination and arm: its values, arm and mean_ic; ``reporting.sweep_table`` sums them up."""
    return [chosen | {"arm": arm, "mean_ic": objective(chosen, made, arm)} for chosen, made in trials(grid, settings) for arm in arms]
