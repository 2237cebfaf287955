"""Row universe and column quality filters. Statistics of all columns come from one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from causalpanel.functions.guards import is_missing, safe_corr

#: Aggregates in one select, at most (wide plans compile slowly).
CHUNK = 30


def universe(conditions: dict[str, object], not_null: list[str] = (), excluded: dict[str, list] | None = None, since: tuple[str, object] | None = None) -> Column:
    """A conjunction of equalities, memberships, exclusions, non-null ids and a first date."""
    found = F.lit(True)
    for name, wanted in conditions.items():
        found &= F.col(name).isin(*wanted) if isinstance(wanted, (list, tuple)) else F.col(name) == wanted
    for name in not_null:
        found &= F.col(name).isNotNull()
    for name, unwanted in (excluded or {}).items():
        found &= ~F.col(name).isin(*unwanted)
    return found & (F.col(since[0]) >= F.lit(since[1])) if since else found


def without_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``right`` without the columns that ``left`` supplies already, keys kept."""
    return right.select(*[c for c in right.columns if c in keys or c not in left.columns])


def drop_non_numeric(d: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str]]:
    dropped = [f.name for f in d.schema if f.name not in keep and not isinstance(f.dataType, NumericType)]
    return d.drop(*dropped), dropped


def chunked(d: DataFrame, made: dict[str, Column], size: int = CHUNK) -> dict[str, object]:
    """The aggregates ``made``, a job for each ``size`` of them."""
    names, out = list(made), {}
    for k in range(0, len(names), size):
        out |= d.agg(*[made[n].alias(n) for n in names[k : k + size]]).first().asDict()
    return out


def melt(d: DataFrame, made: dict[str, Column], name: str = "feature", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """The aggregates ``made`` (by group) as rows (name, value): one aggregation, then an unpivot."""
    wide = d.groupBy(*by).agg(*[c.alias(n) for n, c in made.items()])
    return wide.unpivot(list(by), list(made), name, value)


def missing_shares(d: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, missing_share): NULL or NaN; NULL for an empty frame."""
    return melt(d, {c: F.avg(is_missing(F.col(c)).cast("double")) for c in columns}, value="missing_share")


def drop_missing(d: DataFrame, columns: list[str], most: float = 0.3) -> tuple[DataFrame, list[str]]:
    shares = chunked(d, {c: F.avg(is_missing(F.col(c)).cast("double")) for c in columns}) if columns else {}
    dropped = [c for c, share in shares.items() if share is not None and share > most]
    return d.drop(*dropped), dropped


def static_shares(d: DataFrame, columns: list[str], entity: str, ratio: float = 0.10) -> DataFrame:
    """(feature, static_share): entities in which a feature hardly varies, of all entities.

    Missing counts as 0. Static: root mean square 0, or sample deviation below ``ratio`` of it; an
    entity of one row is never static but counts.
    """
    filled = d.select(entity, *[F.coalesce(F.when(~is_missing(F.col(c)), F.col(c)), F.lit(0.0)).alias(c) for c in columns])
    stats = [x for c in columns for x in (F.stddev_samp(c).alias(f"s_{c}"), F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"r_{c}"))]
    per = filled.groupBy(entity).agg(*stats)
    flag = lambda c: F.coalesce((F.col(f"r_{c}") == 0) | (F.col(f"s_{c}") < ratio * F.col(f"r_{c}")), F.lit(False)) & F.col(f"s_{c}").isNotNull()
    return melt(per, {c: F.avg(flag(c).cast("double")) for c in columns}, value="static_share")


def drop_static(d: DataFrame, columns: list[str], entity: str, ratio: float = 0.10, most: float = 0.5) -> tuple[DataFrame, list[str]]:
    dropped = [r["feature"] for r in static_shares(d, columns, entity, ratio).where(F.col("static_share") > most).collect()]
    return d.drop(*dropped), dropped


def coverage(d: DataFrame, columns: list[str], group: str) -> DataFrame:
    """(feature, covered): the share of groups with one value of the feature or more."""
    per = d.groupBy(group).agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in columns])
    return melt(per, {c: F.avg(F.col(c).cast("double")) for c in columns}, value="covered")


def infinity_counts(d: DataFrame, columns: list[str]) -> DataFrame:
    return melt(d, {c: F.count_if(F.col(c).isin(float("inf"), float("-inf"))) for c in columns}, value="infinities")


def pearson(d: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, correlation) with the target; NULL where either side is constant."""
    return melt(d, {c: safe_corr(F.col(c), F.col(target)) for c in columns}, value="correlation")


def sample_entities(d: DataFrame, entity: str, sector: str, count: int, seed: int) -> DataFrame:
    """Rows of ``count`` entities per sector at most, chosen by a seeded hash: a sampling operator."""
    from pyspark.sql import Window

    order = Window.partitionBy(sector).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(entity).cast("string"))), entity)
    kept = d.select(entity, sector).distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= count)
    return d.join(kept.select(entity, sector), [entity, sector], "left_semi")


def candidates(d: DataFrame, structural: list[str]) -> list[str]:
    """The columns that may be selected: all but the structural ones, in the frame's order; no job."""
    return [c for c in d.columns if c not in structural]


def apply_selected(d: DataFrame, selected: list[str], structural: list[str]) -> DataFrame:
    """Structural columns and the selected ones that there are, in the frame's order."""
    return d.select(*[c for c in d.columns if c in structural or c in selected])


def delete_features(d: DataFrame, features: list[str], structural: list[str] = ()) -> DataFrame:
    """``d`` without the named features; structural columns stay whatever the list says."""
    return d.drop(*[c for c in features if c not in structural])


def column_cap(d: DataFrame, required: list[str], most: int) -> DataFrame:
    rest = [c for c in d.columns if c not in required]
    return d.select(*required, *rest[: max(0, most - len(required))])
