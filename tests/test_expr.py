"""The expression language: grammar, canonical forms, and the compiler against a join-per-operator model."""

import random

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st

from causalpanel.operators.temporal import TemporalOp, vocabulary
from causalpanel.plans.expr import Chain, Grammar, Leaf, Temporal, canonical, chain, evaluate, feature_frame, winsorize

NAMES = ["a", "b", "c"]
GRAMMAR = Grammar(NAMES, most_leaves=5)


@given(st.integers(0, 10**9))
def test_variation_stays_valid(seed):
    rng = random.Random(seed)
    a, b = GRAMMAR.random(rng), GRAMMAR.random(rng)
    for e in (a, b, GRAMMAR.crossover(a, b, rng), GRAMMAR.mutate(a, rng), GRAMMAR.wrap(a, rng), canonical(a), *GRAMMAR.unwrapped(a)):
        assert GRAMMAR.valid(e)
        assert len(e.leaves()) >= 1


def test_redundant_wraps_are_refused():
    rng, plain = random.Random(1), chain([Leaf("a"), Leaf("b")], ["+"])
    for _ in range(200):
        e = GRAMMAR.wrap(plain, rng)
        for t in e.terms():
            assert not (isinstance(t, Temporal) and t.op.linear and isinstance(t.inner, Chain))


def test_canonical_forms():
    lag = lambda k, e: Temporal(TemporalOp("lag", k), e)
    mean = lambda k, e: Temporal(TemporalOp("mean", k), e)
    delta = lambda k, e: Temporal(TemporalOp("delta", k), e)
    x = Leaf("a")
    assert canonical(lag(1, lag(1, x))) == lag(2, x) and canonical(lag(2, lag(2, x))) == lag(4, x)
    assert canonical(lag(1, lag(2, x))) == lag(2, lag(1, x))  # no lag of three in the vocabulary
    assert canonical(mean(3, lag(1, x))) == lag(1, mean(3, x))
    assert canonical(delta(1, delta(1, x))) == delta(1, delta(1, x))
    assert canonical(mean(2, mean(2, x))) == mean(2, mean(2, x))


def test_counts():
    e = chain([Leaf("a"), Temporal(TemporalOp("growth", 1), chain([Leaf("b"), Leaf("a")], ["*"])), Leaf("c")], ["+", "/"])
    assert e.leaves() == ["a", "b", "a", "c"] and e.depth() == 1 and e.families() == ["growth"] and str(e) == "a + growth1(b * a) / c"
    assert set(vocabulary()) == {f"{f}{k}" for k in (1, 2, 4) for f in ("lag", "delta", "growth")} | {f"{f}{w}" for w in (2, 3, 4) for f in ("mean", "std")}


def guarded(d):
    return d if abs(d) >= 1e-6 else (-1e-6 if d < 0 else 1e-6)


def model(e, frame):
    """{row: value} of the rows that survive, by joining frames operator by operator."""
    if isinstance(e, Leaf):
        return {k: r[e.name] for k, r in frame.items() if r["ok"] and r[e.name] is not None}
    if isinstance(e, Temporal):
        inner, out = model(e.inner, frame), {}
        k = e.op.period
        for entity in {x for x, _ in inner}:
            rows = sorted(d for x, d in inner if x == entity)
            for n, d in enumerate(rows):
                v, old = inner[entity, d], inner[entity, rows[n - k]] if n >= k else None
                if e.op.family in ("mean", "std"):
                    w = pd.Series([inner[entity, x] for x in rows[max(0, n - k + 1) : n + 1]], dtype=float)
                    r = w.mean() if e.op.family == "mean" else w.std()
                    out[entity, d] = None if pd.isna(r) else r
                elif e.op.family == "lag":
                    out[entity, d] = old
                elif v is None or old is None:
                    out[entity, d] = None
                else:
                    out[entity, d] = v - old if e.op.family == "delta" else (v - old) / guarded(old)
        return out
    out = model(e.first, frame)
    for sign, t in e.rest:
        other = model(t, frame)
        step = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": lambda x, y: x / guarded(y)}[sign]
        out = {k: None if out[k] is None or other[k] is None else step(out[k], other[k]) for k in out.keys() & other.keys()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_compiler_equals_the_join_model(spark, seed):
    rng = random.Random(seed)
    rows = [(e, d, *[None if rng.random() < 0.2 else round(rng.uniform(-3, 3), 2) for _ in NAMES], rng.random() > 0.1) for e in range(3) for d in range(8)]
    grammar = Grammar(NAMES, most_leaves=3, wrap_rate=0.9)
    population = list(dict.fromkeys(grammar.random(rng) for _ in range(12)))
    found = evaluate(spark.createDataFrame(rows, "entity int, day int, a double, b double, c double, ok boolean"), population, "entity", "day", "ok").collect()
    frame = {(r[0], r[1]): dict(zip([*NAMES, "ok"], r[2:], strict=True)) for r in rows}
    for k, e in enumerate(population):
        expected = model(e, frame)
        for r in found:
            key = (r["entity"], r["day"])
            assert r[f"m{k}"] == (key in expected), (str(e), key)
            if key in expected:
                value = expected[key]
                assert (r[f"e{k}"] is None) if value is None else r[f"e{k}"] == pytest.approx(value, rel=1e-6, abs=1e-9), (str(e), key)


def test_months_share_their_reports_value(spark):
    rows = [("x", d, m, 0.1, 0.2, v) for d, v, months in ((1, 10.0, (1, 2)), (2, 12.0, (3, 4)), (3, 9.0, (5, 6))) for m in months] + [("x", 3, 7, None, 0.2, 9.0)]
    panel = spark.createDataFrame(rows, "entity string, period int, month int, r double, p double, f double")
    found = feature_frame(panel, [Temporal(TemporalOp("lag", 1), Leaf("f"))], ["f"], "entity", "period", ["entity", "month", "r", "p"])
    assert {r["month"]: r["e0"] for r in found.collect()} == {1: None, 2: None, 3: 10.0, 4: 10.0, 5: 12.0, 6: 12.0}


def test_winsorize_uses_train_bounds_and_keeps_missing(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(True, float(k)) for k in range(101)] + [(False, 1e6), (False, -1e6), (False, None), (False, float("nan"))], "train boolean, x double")
    got = [r["x"] for r in winsorize(d, F.col("train"), ["x"]).where("not train").collect()]
    assert got[:3] == [99.0, 1.0, None] and got[3] != got[3]
