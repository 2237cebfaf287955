"""Walk-forward folds with an embargo, seeds and fingerprints."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    """Year windows, both ends included; ``validation`` only for final folds."""

    name: str
    category: str
    train: tuple[int, int]
    test: tuple[int, int]
    validation: tuple[int, int] | None = None


def fold_boundaries(years: list[int], width: int = 2, development: int = 5, final: int | None = 5, split: float = 0.80) -> list[Fold]:
    """Development folds and then final ones, counted from the last year back; partial windows go.

    Without ``final`` the last fifth of the years, in whole windows, is final. A final fold keeps the
    window before its test for inner validation.
    """
    years = sorted(years)
    cut = max(0, len(years) - final * width) if final is not None else int(len(years) * split) // width * width
    begin = max(0, cut - development * width - 1)
    windows = lambda ys: [(ys[k], ys[k + width - 1]) for k in range(0, len(ys) - width + 1, width)]
    found = [Fold(f"fold_{n:02d}", "development", (years[0], a - 1), (a, b)) for n, (a, b) in enumerate(windows(years[begin + 1 : cut]), 1)]
    return found + [Fold(f"fold_{n:02d}", "final_test", (years[0], a - width - 1), (a, b), (a - width, a - 1)) for n, (a, b) in enumerate(windows(years[cut:]), 1)]


def years_of(panel: DataFrame, day: str) -> list[int]:
    return [r[0] for r in panel.select(F.year(day)).distinct().orderBy(F.year(day)).collect()]


def embargo_end(year: int, months: int) -> date:
    """The last day that leaves ``months`` months of ``year`` unused."""
    k = year * 12 + 12 - months
    return date(k // 12, k % 12 + 1, 1) - timedelta(days=1)


def split(panel: DataFrame, fold: Fold, day: str, embargo: int = 1) -> DataFrame:
    """``panel`` rows of the fold with ``split``: train and validation end before their embargo."""
    d = F.col(day)
    within = lambda w, e: d.between(date(w[0], 1, 1), embargo_end(w[1], e))
    part = F.when(within(fold.train, embargo), "train")
    if fold.validation:
        part = part.when(within(fold.validation, embargo), "validation")
    return panel.withColumn("split", part.when(within(fold.test, 0), "test")).where("split is not null")


def derive_seed(*parts) -> int:
    """A seed of 31 bits that depends on all parts and on their order; a number counts as its text."""
    digest = hashlib.blake2b(json.dumps([str(p) for p in parts]).encode(), digest_size=4).hexdigest()
    return int(digest, 16) >> 1


def fingerprint(features: list[str], fold: Fold, config: dict) -> str:
    """Names a fold's run: the same inputs and settings, wherever the output goes."""
    kept = {k: v for k, v in config.items() if k != "output_dir"}
    return hashlib.sha256(json.dumps([sorted(features), asdict(fold), kept], sort_keys=True, default=str).encode()).hexdigest()
