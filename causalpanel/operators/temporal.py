"""Temporal operators on the report grain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalpanel.functions.guards import safe_div

LAGS, WINDOWS = (1, 2, 4), (2, 3, 4)


@dataclass(frozen=True)
class TemporalOp:
    family: str
    period: int

    @property
    def name(self) -> str:
        return f"{self.family}{self.period}"

    @property
    def linear(self) -> bool:
        return self.family in ("lag", "delta", "mean")

    def over(self, value: Column, partition: list[Column | str], order: str) -> Column:
        """The operator over rows of ``partition`` in ``order``: NULL where there is no history."""
        window = Window.partitionBy(*partition).orderBy(order)
        if self.family in ("mean", "std"):
            trailing = window.rowsBetween(1 - self.period, 0)
            return (F.avg if self.family == "mean" else F.stddev_samp)(value).over(trailing)
        before = F.lag(value, self.period).over(window)
        return {"lag": before, "delta": value - before, "growth": safe_div(value - before, before)}[self.family]


def vocabulary(lags=LAGS, windows=WINDOWS) -> dict[str, TemporalOp]:
    ops = [TemporalOp(f, k) for k in lags for f in ("lag", "delta", "growth")] + [TemporalOp(f, w) for w in windows for f in ("mean", "std")]
    return {op.name: op for op in ops}


def add_temporal(d: DataFrame, columns: list[str], entity: str, date: str, ops: list[TemporalOp]) -> DataFrame:
    """``d`` with ``column_op`` for every column and operator; all share one window order."""
    return d.withColumns({f"{c}_{op.name}": op.over(F.col(c), [entity], date) for c in columns for op in ops})


def at_months(months: DataFrame, values: DataFrame, entity: str, date: str) -> DataFrame:
    """Report-grain values joined to the months of each report, once for all columns."""
    kept = values.select(entity, date, *[c for c in values.columns if c not in months.columns])
    return months.join(kept, [entity, date], "left")
