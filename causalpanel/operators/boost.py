"""Many small boosted-tree fits in one pass: a group of rows per model, histograms in numpy.

A search fits the same rows to another expression each time; a distributed fit per expression is a long
row of tiny jobs. Here the training rows of all models are dealt by model, each group is fitted in one
task, and all models then score the held-out rows where these lie.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causalpanel.functions.guards import is_missing
from causalpanel.session import ship

#: Training rows of a model, at most: a larger frame gives a hash-random sample of about as many, which
#: is what bounds a task. Held-out rows are all scored.
MOST_ROWS = 400_000
TREES, DEPTH, RATE, BINS, LEAST = 85, 5, 0.1, 64, 1


@dataclass
class Model:
    """Complete binary trees: (trees, 2**depth - 1) inputs and cuts, (trees, 2**depth) values.

    Inputs are clipped to ``low`` and ``high``, the training rows' quantiles, or left alone (infinite).
    """

    low: np.ndarray
    high: np.ndarray
    base: float
    inputs: np.ndarray
    cuts: np.ndarray
    values: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.clip(x, self.low, self.high)
        out, rows, nodes = np.full(len(x), self.base), np.arange(len(x)), self.inputs.shape[1]
        for inputs, cuts, values in zip(self.inputs, self.cuts, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < nodes:
                at = 2 * at + 1 + (x[rows, inputs[at]] > cuts[at])
            out += values[at - nodes]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: int = LEAST, clip: float | None = None, free: int = 0) -> Model:
    """Boosted regression trees for the squared error, over quantile bins; deterministic in the rows' order.

    With ``clip`` all inputs but the ``free`` first are winsorized at that share and its complement.
    A node is split where the squared error falls most, the first input and the lowest cut of equals,
    if each side keeps ``least`` rows.
    """
    n, width = x.shape
    low, high = np.full(width, -np.inf), np.full(width, np.inf)
    if clip is not None and free < width:
        low[free:], high[free:] = np.quantile(x[:, free:], [clip, 1 - clip], axis=0, method="inverted_cdf")
        x = np.clip(x, low, high)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    padded = np.stack([np.pad(e, (0, bins - len(e)), constant_values=np.inf) for e in edges])
    base, rows = float(y.mean()), np.arange(n)
    left = y - base
    inputs, cuts, values = np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth))
    for t in range(trees):
        node = np.zeros(n, np.int64)
        for level in range(depth):
            count = 1 << level
            best, at, cut = np.zeros(count), np.zeros(count, np.int64), np.zeros(count, np.int64)
            for j in range(width):
                cell = node * bins + codes[:, j]
                many = np.bincount(cell, minlength=count * bins).reshape(count, bins).cumsum(axis=1)
                total = np.bincount(cell, left, count * bins).reshape(count, bins).cumsum(axis=1)
                a, b = many[:, :-1], many[:, -1:] - many[:, :-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = total[:, :-1] ** 2 / a + (total[:, -1:] - total[:, :-1]) ** 2 / b - total[:, -1:] ** 2 / (a + b)
                gain = np.where((a >= least) & (b >= least), gain, 0.0)
                k = gain.argmax(axis=1)
                found = gain[np.arange(count), k]
                better = found > best + 1e-12
                best, at, cut = np.where(better, found, best), np.where(better, j, at), np.where(better, k, cut)
            split = best > 0
            here = slice(count - 1, 2 * count - 1)
            inputs[t, here], cuts[t, here] = at, np.where(split, padded[at, cut], np.inf)
            node = 2 * node + (split[node] & (codes[rows, at[node]] > cut[node]))
        many = np.bincount(node, minlength=2**depth)
        values[t] = rate * np.divide(np.bincount(node, left, 2**depth), many, out=np.zeros(2**depth), where=many > 0)
        left -= values[t][node]
    return Model(low, high, base, inputs, cuts, values)


def _rows(d: DataFrame, sets: dict[str, list[str]], label: str, keep: list[str]) -> DataFrame:
    """_model (its number), _x, label, ``keep``: a row per model that has all its inputs there."""
    struct = lambda k, names: F.struct(F.lit(k).alias("_model"), F.array(*[F.col(c).cast("double") for c in names]).alias("_x"))
    rows = F.explode(F.array(*[struct(k, names) for k, names in enumerate(sets.values())]))
    d = d.where(~is_missing(F.col(label).cast("double"))).select(*keep, F.col(label).cast("double").alias("_y"), rows.alias("_r"))
    return d.select(*keep, "_y", "_r.*").where(F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))


def fit_all(train: DataFrame, sets: dict[str, list[str]], label: str, keys: list[str], most_rows: int = MOST_ROWS, **options) -> dict[str, Model]:
    """A model for each named list of inputs; ``keys`` give the rows' order, whatever the partitions.

    A model without rows is left out. Models, some 100 kB each, reach the driver; rows do not.
    """
    import pyarrow as pa

    ship(train.sparkSession)
    names = list(sets)
    order = F.xxhash64(*keys)
    share = min(1.0, most_rows / max(1, train.count()))
    some = train if share == 1 else train.where(F.pmod(F.xxhash64(F.lit("rows"), *keys), F.lit(1 << 30)) < int(share * (1 << 30)))

    def fitted(table):
        at = np.lexsort([table.column("_y").to_numpy(), table.column("_order").to_numpy()])
        x = table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)[at]
        body = pickle.dumps(fit(x, table.column("_y").to_numpy()[at], **options), protocol=5)
        return pa.Table.from_arrays([table.column("_model").slice(0, 1).combine_chunks(), pa.array([body], pa.binary())], ["_model", "body"])

    long = _rows(some.withColumn("_order", order), sets, label, ["_order"])
    long = long.repartitionByRange(len(names), "_model")  # a partition for each model
    return {names[r["_model"]]: pickle.loads(r["body"]) for r in long.groupBy("_model").applyInArrow(fitted, "_model int, body binary").collect()}


def predict_all(test: DataFrame, sets: dict[str, list[str]], models: dict[str, Model], label: str, keep: list[str]) -> DataFrame:
    """model, ``keep``, ``label``, prediction: every row of ``test`` that has a model's inputs, by that model."""
    import pyarrow as pa

    ship(test.sparkSession)
    names = list(sets)
    known = {k: models[n] for k, n in enumerate(names) if n in models}

    def scored(batches):
        for batch in batches:
            which = batch.column("_model").to_numpy()
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.concatenate([[0], batch.column("_x").value_lengths().to_numpy()]))
            out, fine = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for k, model in known.items():
                at = np.flatnonzero(which == k)
                width = len(sets[names[k]])
                if len(at):
                    out[at], fine[at] = model.predict(x[ends[at][:, None] + np.arange(width)]), True
            rows = pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "_y", "_model")), pa.array(out)], [*keep, "_y", "_model", "prediction"])
            yield rows.filter(pa.array(fine))

    d = _rows(test, sets, label, keep)
    kinds = ", ".join(f"`{c}` {t}" for c, t in d.select(*keep).dtypes)
    d = d.mapInArrow(scored, f"{kinds}, _y double, _model int, prediction double")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_model") + 1)
    return d.select(name.alias("model"), *keep, F.col("_y").alias(label), "prediction")
