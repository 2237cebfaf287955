"""Point-in-time joins: as-of carry-forward with a staleness limit, availability dates, causal fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalpanel.functions.guards import inf_to_null

FALLBACK_DAYS = 45


def asof_carry(
    keys: DataFrame, source: DataFrame, value: str, key_id: str, key_date: str, source_id: str, source_date: str,
    max_days: int | None = None, name: str | None = None,
) -> DataFrame:
    """``keys`` with the latest non-null source value dated at or before the key's date.

    Older values than ``max_days`` (strictly) become NULL. Both sides share one time axis per id, so
    there is one shuffle and no join back: a key's columns ride along as a struct. Several source
    rows of one day count as one, of the largest value.
    """
    name = name or value
    marks = source.where(F.col(value).isNotNull() & F.col(source_id).isNotNull() & F.col(source_date).isNotNull())
    marks = marks.groupBy(F.col(source_id).alias("_id"), F.col(source_date).alias("_date")).agg(F.max(value).alias("_value"))
    marks = marks.join(keys.select(F.col(key_id).alias("_id")), "_id", "left_semi")
    rows = keys.select(F.col(key_id).alias("_id"), F.col(key_date).alias("_date"), F.struct(*keys.columns).alias("_row"), F.lit(1).alias("_tag"))
    axis = rows.unionByName(marks.withColumn("_tag", F.lit(0)), allowMissingColumns=True)
    past = Window.partitionBy("_id").orderBy("_date", "_tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(F.col("_tag") == 0, F.struct(F.col("_value").alias("v"), F.col("_date").alias("d"))), ignorenulls=True).over(past)
    found = axis.withColumn("_seen", seen).where("_tag = 1")
    fresh = F.col("_seen.v") if max_days is None else F.when(F.datediff("_date", "_seen.d") <= max_days, F.col("_seen.v"))
    return found.select("_row.*", fresh.alias(name))


def fallback_lag(lags: DataFrame, lag: str = "lag", share: float = 0.9) -> Column:
    """The ``share`` quantile of non-negative observed lags (an observed element), else 45: a scalar subquery."""
    return F.coalesce(lags.where(F.col(lag) >= 0).agg(F.percentile_approx(lag, share, 10000)).scalar(), F.lit(FALLBACK_DAYS)).cast("int")


def availability_date(d: DataFrame, period: str, sources: list[str], name: str = "available", fallback: int | None = None) -> DataFrame:
    """``d`` with the first day each report was known.

    The greatest of the source dates (NULL ones ignored) if it is not before the period's end, else
    the period's end plus the fallback lag.
    """
    latest = F.greatest(*sources) if len(sources) > 1 else F.col(sources[0])
    d = d.withColumn("_lag", F.datediff(latest, F.col(period)))
    days = fallback_lag(d, "_lag") if fallback is None else F.lit(fallback)
    return d.withColumn(name, F.when(F.col("_lag") >= 0, latest).otherwise(F.date_add(F.col(period), days))).drop("_lag")


def causal_fill(d: DataFrame, columns: list[str], entity: str, date: str, max_days: int = 183) -> DataFrame:
    """Each column filled with its last value (infinities count as missing) of ``max_days`` at most."""
    past = Window.partitionBy(entity).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in columns:
        value = inf_to_null(F.col(c))
        seen = F.last(F.when(value.isNotNull(), F.struct(value.alias("v"), F.col(date).alias("d"))), ignorenulls=True).over(past)
        d = d.withColumn(f"_{c}", seen)
    filled = {c: F.when(F.datediff(F.col(date), F.col(f"_{c}.d")) <= max_days, F.col(f"_{c}.v")) for c in columns}
    return d.withColumns(filled).drop(*[f"_{c}" for c in columns])


def align(a: DataFrame, b: DataFrame, entity: str, a_date: str, b_date: str) -> tuple[DataFrame, DataFrame]:
    """Both frames, limited to entities whose date ranges overlap."""
    ra = a.groupBy(entity).agg(F.min(a_date).alias("_a0"), F.max(a_date).alias("_a1"))
    rb = b.groupBy(entity).agg(F.min(b_date).alias("_b0"), F.max(b_date).alias("_b1"))
    kept = ra.join(rb, entity).where("_a0 <= _b1 and _b0 <= _a1").select(entity)
    return a.join(kept, entity, "left_semi"), b.join(kept, entity, "left_semi")
