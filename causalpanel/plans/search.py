"""Seeded evolutionary search over expressions; a whole generation is scored by one plan."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalpanel.operators import boost
from causalpanel.operators.model import errors
from causalpanel.operators.rank import monthly_rank_ic
from causalpanel.plans.expr import Expr, Grammar, canonical, feature_frame, parsed, plain
from causalpanel.plans.folds import derive_seed

Scorer = Callable[[list[Expr]], dict[Expr, float]]


@dataclass
class Settings:
    population: int = 36
    generations: int = 50
    tournament: int = 6
    crossover_share: float = 0.5
    mutation: tuple[float, float] = (0.1, 0.6)
    schedule: str = "decreasing"
    patience: int = 10
    admitted: float = 0.15
    ceiling: int = 50
    retries: int = 3


@dataclass
class State:
    """All that a run needs to go on; ``to_json`` and ``from_json`` keep it between sessions."""

    population: list[Expr]
    known: dict[Expr, float] = field(default_factory=dict)
    best: list[float] = field(default_factory=list)
    admitted: list[float] = field(default_factory=list)
    diversity: list[int] = field(default_factory=list)
    rng: object = None


def to_json(state: State) -> dict:
    """All of a state as JSON values."""
    version, numbers, rest = state.rng
    return {
        "population": [plain(e) for e in state.population], "known": [[plain(e), x] for e, x in state.known.items()],
        "best": state.best, "admitted": state.admitted, "diversity": state.diversity, "rng": [version, list(numbers), rest],
    }


def from_json(data: dict) -> State:
    version, numbers, rest = data["rng"]
    known = {parsed(e): float(x) for e, x in data["known"]}
    return State([parsed(e) for e in data["population"]], known, data["best"], data["admitted"], data["diversity"], (version, tuple(numbers), rest))


def tournament(scores: dict[Expr, float], size: int, rng: random.Random) -> Expr:
    drawn = [rng.choice(list(scores)) for _ in range(size)]
    return max(drawn, key=lambda e: scores[e])


def roulette(scores: dict[Expr, float], rng: random.Random) -> Expr:
    """A draw in proportion to the score above the least one."""
    low = min(scores.values())
    names = list(scores)
    return rng.choices(names, [scores[e] - low + 1e-9 for e in names])[0]


def mutation_rate(settings: Settings, diversity: int) -> float:
    """From the least to the largest rate by how many distinct members there are."""
    low, high = settings.mutation
    n = settings.population
    if settings.schedule == "increasing":
        r = min(1.0, (n - diversity) / (0.75 * n))
    elif settings.schedule == "decreasing":
        r = max(0.0, (diversity - 0.25 * n) / (0.75 * n))
    else:
        r = 1.0
    return low + (high - low) * r


def next_population(scores: dict[Expr, float], grammar: Grammar, settings: Settings, rng: random.Random) -> tuple[list[Expr], float]:
    """Children of tournament winners, then the best; each form once, the best one unchanged.

    Also gives the share of members that no retry could make new.
    """
    rate = mutation_rate(settings, len(scores))
    ranked = sorted(scores, key=lambda e: (-scores[e], str(e)))
    children = [grammar.crossover(tournament(scores, settings.tournament, rng), tournament(scores, settings.tournament, rng), rng) for _ in range(int(settings.population * settings.crossover_share))]
    children = [grammar.mutate(e, rng) if rng.random() < rate else e for e in children]
    elites = [ranked[k % len(ranked)] for k in range(settings.population - len(children))]
    made, forced = [ranked[0]], 0
    for e in [*elites[1:], *children]:
        for _ in range(settings.retries):
            if canonical(e) not in made:
                break
            e = grammar.mutate(e, rng)
        forced += canonical(e) in made
        made.append(canonical(e))
    return made, forced / settings.population


def stopped(state: State, settings: Settings) -> bool:
    last = state.best[-settings.patience :]
    calm = len(last) == settings.patience and len(set(last)) == 1
    stale = len(state.best) >= settings.ceiling and len(set(state.best[-settings.ceiling :])) == 1
    return stale or (calm and sum(state.admitted[-settings.patience :]) / settings.patience >= settings.admitted)


def search(score: Scorer, grammar: Grammar, settings: Settings, seed: int, state: State | None = None, save: Callable[[State], None] | None = None) -> tuple[Expr, State, dict[Expr, float]]:
    """Evolve until nothing new helps. ``score`` gets only forms that it has not scored before."""
    rng = random.Random(seed)
    state = state or State([canonical(grammar.random(rng)) for _ in range(settings.population)])
    if state.rng is not None:
        rng.setstate(state.rng)
    known = state.known
    while True:
        new = [e for e in dict.fromkeys(state.population) if e not in known]
        known |= score(new) if new else {}
        scores = {e: known[e] for e in dict.fromkeys(state.population)}
        best = max(scores, key=lambda e: (scores[e], str(e)))
        state.best.append(scores[best])
        state.diversity.append(len(scores))
        if len(state.best) >= settings.generations or stopped(state, settings):
            return best, state, known
        state.population, forced = next_population(scores, grammar, settings, rng)
        state.admitted.append(forced)
        state.rng = rng.getstate()
        if save:
            save(state)


def random_search(score: Scorer, grammar: Grammar, evaluations: int, seed: int) -> tuple[Expr, dict[Expr, float]]:
    """The baseline: as many random forms as the search has scored."""
    rng = random.Random(derive_seed(seed, "sampler"))
    drawn: dict[Expr, None] = {}
    for _ in range(20 * evaluations):
        if len(drawn) >= evaluations:
            break
        drawn[canonical(grammar.random(rng))] = None
    scores = score(list(drawn))
    return max(scores, key=lambda e: (scores[e], str(e))), scores


@dataclass
class PanelScorer:
    """Scores expressions on a panel with ``split``: fit on train, mean monthly rank IC (or -RMSE) on ``on``.

    All expressions of a call are one frame, one pass of fits (``boost``) and one of predictions. With
    ``release`` the panel's cached blocks go; those of a call go at its end.
    """

    panel: DataFrame
    leaves: list[str]
    entity: str = "entity"
    date: str = "period_end"
    month: str = "target_date"
    target: str = "monthly_return"
    predictors: tuple[str, ...] = ("prev_month_return", "prev_month_sector_return")
    on: str = "test"
    trees: int = boost.TREES
    metric: str = "ic"

    def __post_init__(self):
        self.panel = self.panel.persist()  # every generation reads it again

    def release(self) -> None:
        self.panel.unpersist()

    def frame(self, population: list[Expr]) -> DataFrame:
        """Rows of train and ``on`` with e{k} and ``_train``; the fits clip to train's quantiles."""
        required = [self.entity, self.month, *self.predictors, self.target]
        train = feature_frame(self.panel.where("split = 'train'"), population, self.leaves, self.entity, self.date, required)
        both = feature_frame(self.panel.where(F.col("split").isin("train", self.on)), population, self.leaves, self.entity, self.date, required)
        d = train.unionByName(both.where(F.col("split") == self.on)).withColumn("_train", F.col("split") == "train")
        return d.withColumns({f"e{k}": F.when(F.col(f"m{k}"), F.col(f"e{k}")) for k in range(len(population))})

    def predictions(self, sets: dict[str, list[str]], d: DataFrame) -> DataFrame:
        """model, entity, month, target, prediction of the held-out rows, for every list of inputs."""
        models = boost.fit_all(d.where("_train"), sets, self.target, [self.entity, self.month], trees=self.trees, clip=0.01, free=len(self.predictors))
        return boost.predict_all(d.where("not _train"), sets, models, self.target, [self.entity, self.month])

    def held_out(self, population: list[Expr], together: bool = False) -> tuple[DataFrame, DataFrame]:
        """Predictions by expression (its number is the model), or of one model of them all; and the cached frame."""
        names = [f"e{k}" for k in range(len(population))]
        d = self.frame(population).persist()
        sets = {"all": [*self.predictors, *names]} if together else {str(k): [*self.predictors, c] for k, c in enumerate(names)}
        return self.predictions(sets, d), d

    def __call__(self, population: list[Expr]) -> dict[Expr, float]:
        p, held = self.held_out(population)
        if self.metric == "ic":
            found = monthly_rank_ic(p, self.month, self.target, by=("model",)).groupBy("model").agg(F.avg("ic").alias("x"))
        else:
            found = errors(p, self.target, ("model",)).select("model", (-F.col("rmse")).alias("x"))
        scores = {r["model"]: r["x"] for r in found.collect()}  # a row per expression
        held.unpersist()
        return {e: float(scores.get(str(k), float("-inf"))) for k, e in enumerate(population)}


def baseline_predictions(panel: DataFrame, scorer: PanelScorer) -> DataFrame:
    """The fixed predictors alone, with the same fit as any winner's."""
    d = panel.where(F.col("split").isin("train", scorer.on)).withColumn("_train", F.col("split") == "train")
    return scorer.predictions({"fixed": list(scorer.predictors)}, d)
