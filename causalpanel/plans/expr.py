"""A small expression language over panel columns: trees, their grammar, and their compiler.

Arithmetic runs from left to right without precedence. A whole population compiles into one plan on
the report grain: leaves are constant within (entity, report), so values are computed once a report
and joined to the months once.
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causalpanel.functions.guards import is_missing, null_safe_clip, safe_div
from causalpanel.operators.temporal import LAGS, TemporalOp, vocabulary

ARITHMETIC = ("+", "-", "*", "/")
ACCURACY = 10_000


class Expr:
    """A leaf, a temporal operator over an expression, or a chain of terms."""

    def terms(self) -> tuple[Expr, ...]:
        return (self,)

    def leaves(self) -> list[str]:
        return [x for t in self.terms() for x in t.leaves()]

    def depth(self) -> int:
        """Temporal operators on the deepest way down."""
        return max(t.depth() for t in self.terms())

    def nesting(self) -> int:
        return max(t.nesting() for t in self.terms())

    def kind(self) -> str:
        return "raw"

    def families(self) -> list[str]:
        return [x for t in self.terms() for x in t.families()]


@dataclass(frozen=True)
class Leaf(Expr):
    name: str

    def leaves(self):
        return [self.name]

    def depth(self):
        return 0

    def nesting(self):
        return 0

    def families(self):
        return []

    def __str__(self):
        return self.name


@dataclass(frozen=True)
class Temporal(Expr):
    op: TemporalOp
    inner: Expr

    def leaves(self):
        return self.inner.leaves()

    def depth(self):
        return 1 + self.inner.depth()

    def nesting(self):
        return 1 + self.inner.nesting()

    def kind(self):
        return self.op.family

    def families(self):
        return [self.op.family, *self.inner.families()]

    def __str__(self):
        return f"{self.op.name}({self.inner})"


@dataclass(frozen=True)
class Chain(Expr):
    """``first`` and then (sign, term) pairs, folded from the left; a chain as a term has brackets."""

    first: Expr
    rest: tuple[tuple[str, Expr], ...]

    def terms(self):
        return (self.first, *[t for _, t in self.rest])

    def nesting(self):
        return max(t.nesting() + isinstance(t, Chain) for t in self.terms())

    def __str__(self):
        part = lambda t: f"({t})" if isinstance(t, Chain) else str(t)
        return "".join([part(self.first), *[f" {s} {part(t)}" for s, t in self.rest]])


def chain(terms: list[Expr], signs: list[str]) -> Expr:
    return terms[0] if len(terms) == 1 else Chain(terms[0], tuple(zip(signs, terms[1:], strict=True)))


def plain(e: Expr) -> str | list:
    """An expression as JSON values: a leaf's name, [operator, period, inner], or [first, sign, term, ...]."""
    if isinstance(e, Leaf):
        return e.name
    if isinstance(e, Temporal):
        return [e.op.family, e.op.period, plain(e.inner)]
    return [plain(e.first), *[x for s, t in e.rest for x in (s, plain(t))]]


def parsed(x: str | list) -> Expr:
    """The expression that ``plain`` wrote."""
    if isinstance(x, str):
        return Leaf(x)
    if isinstance(x[1], int):
        return Temporal(TemporalOp(x[0], x[1]), parsed(x[2]))
    return Chain(parsed(x[0]), tuple((s, parsed(t)) for s, t in zip(x[1::2], x[2::2], strict=True)))


def canonical(e: Expr, periods: tuple[int, ...] = LAGS) -> Expr:
    """Stacked lags become one lag if the vocabulary has it; a lag moves inside a mean.

    Only exact identities are used. Lags whose sum is no lag of ``periods`` stay nested, the longer outside.
    """
    if isinstance(e, Chain):
        return Chain(canonical(e.first, periods), tuple((s, canonical(t, periods)) for s, t in e.rest))
    if not isinstance(e, Temporal):
        return e
    inner = canonical(e.inner, periods)
    if e.op.family == "lag" and isinstance(inner, Temporal) and inner.op.family == "lag":
        if e.op.period + inner.op.period in periods:
            return canonical(Temporal(TemporalOp("lag", e.op.period + inner.op.period), inner.inner), periods)
        low, high = sorted((e.op, inner.op), key=lambda op: op.period)
        return Temporal(high, Temporal(low, inner.inner))
    if e.op.family == "mean" and isinstance(inner, Temporal) and inner.op.family == "lag":
        return canonical(Temporal(inner.op, Temporal(e.op, inner.inner)), periods)
    return Temporal(e.op, inner)


@dataclass
class Grammar:
    """What expressions may look like, and how they vary."""

    features: list[str]
    most_leaves: int = 4
    most_depth: int = 2
    most_nesting: int = 2
    wrap_rate: float = 0.2
    unwrap_rate: float = 0.1
    ops: dict[str, TemporalOp] = field(default_factory=vocabulary)

    def valid(self, e: Expr) -> bool:
        return len(e.leaves()) <= self.most_leaves and e.depth() <= self.most_depth and e.nesting() <= self.most_nesting and self._sound(e)

    def _sound(self, e: Expr) -> bool:
        if isinstance(e, Chain):
            return bool(e.rest) and all(s in ARITHMETIC for s, _ in e.rest) and all(self._sound(t) for t in e.terms())
        if isinstance(e, Temporal):
            return e.op in self.ops.values() and self._sound(e.inner)
        return e.name in self.features

    def random(self, rng: random.Random) -> Expr:
        n = rng.randint(1, self.most_leaves)
        e = chain([Leaf(rng.choice(self.features)) for _ in range(n)], [rng.choice(ARITHMETIC) for _ in range(n - 1)])
        return self.wrap(e, rng) if self.ops and rng.random() < self.wrap_rate else e

    def crossover(self, a: Expr, b: Expr, rng: random.Random) -> Expr:
        """A child of both: a run of one parent's terms takes the place of a run of the other's."""
        ta, tb = list(a.terms()), list(b.terms())
        sa, sb = [s for s, _ in getattr(a, "rest", ())], [s for s, _ in getattr(b, "rest", ())]
        for _ in range(20):
            i, k = sorted(rng.sample(range(len(ta) + 1), 2))
            j, m = sorted(rng.sample(range(len(tb) + 1), 2))
            made = ta[:i] + tb[j:m] + ta[k:]
            spare = [*sa[: max(0, i - 1)], *sb[j : m - 1], *sa[k:]]
            signs = [spare[n] if n < len(spare) else rng.choice(ARITHMETIC) for n in range(len(made) - 1)]
            child = chain(made, signs)
            if self.valid(child) and child not in (a, b):
                return child
        return a if rng.random() > 0.5 else b

    def mutate(self, e: Expr, rng: random.Random) -> Expr:
        draw = rng.random()
        if self.ops and draw < self.wrap_rate:
            return self.wrap(e, rng)
        if draw < self.wrap_rate + self.unwrap_rate:
            options = self.unwrapped(e)
            return rng.choice(options) if options else e
        return self._change(e, rng)

    def _change(self, e: Expr, rng: random.Random) -> Expr:
        """One leaf, sign or temporal operator replaced."""
        if isinstance(e, Leaf):
            return Leaf(rng.choice([f for f in self.features if f != e.name] or self.features))
        if isinstance(e, Temporal):
            if rng.random() < 0.5:
                return replace(e, op=rng.choice(list(self.ops.values())))
            return replace(e, inner=self._change(e.inner, rng))
        at = rng.randrange(2 * len(e.rest) + 1)
        terms, signs = list(e.terms()), [s for s, _ in e.rest]
        if at % 2:
            signs[at // 2] = rng.choice([s for s in ARITHMETIC if s != signs[at // 2]])
        else:
            terms[at // 2] = self._change(terms[at // 2], rng)
        return chain(terms, signs)

    def wrap(self, e: Expr, rng: random.Random) -> Expr:
        """A run of terms under a temporal operator. Linear operators over sums say nothing new."""
        terms, signs = list(e.terms()), [s for s, _ in getattr(e, "rest", ())]
        for _ in range(20):
            i, k = sorted(rng.sample(range(len(terms) + 1), 2))
            op, inner = rng.choice(list(self.ops.values())), chain(terms[i:k], signs[i : k - 1])
            if op.linear and isinstance(inner, Chain) and all(s in "+-" for s, _ in inner.rest):
                continue
            made = chain([*terms[:i], Temporal(op, inner), *terms[k:]], [*signs[:i], *signs[k - 1 :]])
            if self.valid(made):
                return made
        return e

    def unwrapped(self, e: Expr) -> list[Expr]:
        """All valid forms with one temporal operator taken away, its terms spliced in."""
        terms, signs, found = list(e.terms()), [s for s, _ in getattr(e, "rest", ())], []
        for k, t in enumerate(terms):
            if not isinstance(t, Temporal):
                continue
            inner, own = list(t.inner.terms()), [s for s, _ in getattr(t.inner, "rest", ())]
            found.append(chain([*terms[:k], *inner, *terms[k + 1 :]], [*signs[:k], *own, *signs[k:]]))
            found += [chain([*terms[:k], Temporal(t.op, x), *terms[k + 1 :]], signs) for x in self.unwrapped(t.inner)]
        return [x for x in dict.fromkeys(found) if self.valid(x)]


def evaluate(reports: DataFrame, population: list[Expr], entity: str, date: str, base_ok: str) -> DataFrame:
    """``entity``, ``date`` and, for expression k, e{k} (value) and m{k} (whether its rows survive).

    ``base_ok`` says whether a report has a usable month at all. A report survives for an
    expression if every leaf of it is there; a temporal operator sees the reports that survive for
    what it is over, so "one report ago" skips the others. Each temporal level is one projection;
    windows by (entity, mask) share the exchange by entity.
    """
    columns: dict[Temporal, str] = {}
    d = reports

    def mask(e: Expr) -> Column:
        found = F.col(base_ok)
        for name in dict.fromkeys(e.leaves()):
            found = found & ~is_missing(F.col(name))
        return F.coalesce(found, F.lit(False))

    def value(e: Expr) -> Column:
        if isinstance(e, Leaf):
            return F.col(e.name)
        if isinstance(e, Temporal):
            return F.col(columns[e])
        out = value(e.first)
        for sign, t in e.rest:
            x = value(t)
            out = {"+": out + x, "-": out - x, "*": out * x}[sign] if sign != "/" else safe_div(out, x)
        return out

    def temporals(e: Expr) -> list[Temporal]:
        own = [e] if isinstance(e, Temporal) else []
        return own + [x for t in ([e.inner] if own else e.terms() if isinstance(e, Chain) else []) for x in temporals(t)]

    wanted = list(dict.fromkeys(t for e in population for t in temporals(e)))
    for level in sorted({t.depth() for t in wanted}):
        made = {}
        for t in (t for t in wanted if t.depth() == level):
            ok = mask(t.inner)
            name = f"_t{len(columns) + len(made)}"
            made[t] = (name, F.when(ok, t.op.over(value(t.inner), [entity, ok], date)))
        d = d.withColumns(dict(made.values()))
        columns |= {t: name for t, (name, _) in made.items()}
    values = [c for k, e in enumerate(population) for c in (value(e).cast("double").alias(f"e{k}"), mask(e).alias(f"m{k}"))]
    return d.select(entity, date, *values)


def feature_frame(panel: DataFrame, population: list[Expr], leaves: list[str], entity: str, date: str, required: list[str]) -> DataFrame:
    """``panel`` rows with every required column there, with e{k} and m{k} joined once by report."""
    ok = F.lit(True)
    for c in required:
        ok = ok & ~is_missing(F.col(c)) if dict(panel.dtypes)[c] in ("double", "float") else ok & F.col(c).isNotNull()
    grain = panel.groupBy(entity, date).agg(*[F.first(c).alias(c) for c in leaves], F.max(ok).alias("_ok"))
    values = evaluate(grain, population, entity, date, "_ok")
    return panel.where(ok).join(values, [entity, date])


def winsorize(d: DataFrame, train: Column, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``d`` with each column clipped to its quantiles over the rows of ``train``; missing values stay.

    A quantile is an observed value whose rank is off by one in ACCURACY at most (exact for fewer rows).
    """
    kept = lambda c: F.when(train & ~is_missing(F.col(c)), F.col(c))
    found = d.agg(F.struct(*[F.percentile_approx(kept(c), [low, high], ACCURACY).alias(c) for c in columns]).alias("_b")).scalar()
    bound = lambda c, k: F.get(found[c], F.lit(k))
    return d.withColumns({c: F.when(found[c].isNull(), F.col(c)).otherwise(null_safe_clip(F.col(c), bound(c, 0), bound(c, 1))) for c in columns}) if columns else d
