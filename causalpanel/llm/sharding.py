"""Sharding by sampled splitters.

Rows are ordered by (crc32 of the text, doc_id), so that equal texts lie side by side. A
size-weighted sample of the keys gives quantile boundaries of many small ranges; ranges that turn
out overfull are sampled again and subdivided. Exact byte and row offsets of the ranges, and a window
inside each range, then place every row: the law is ``bytes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_hash

SHARDS = 16
#: Rows in one range, about; ranges at most, which bounds the boundary list (24 bytes each).
PER_RANGE, MOST_RANGES = 2000, 16384
#: Draws per range; a range of more than OVERFULL times the mean bytes is subdivided.
DRAWS, OVERFULL = 16, 2.0


def _boundaries(rows: DataFrame, step: float, salt: str) -> DataFrame:
    """Keys at the quantiles of a size-weighted sample: one for every ``step`` bytes, about.

    A row is drawn floor(size * DRAWS / step + u) times, u uniform by a hash of its key: a sample of
    about DRAWS keys a range, whatever the input's size.
    """
    u = F.pmod(F.xxhash64("_key", F.lit(salt)), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.withColumn("_n", F.floor(F.col("size") * F.lit(DRAWS / step) + u)).where("_n > 0").select("_key", "_n")
    upto = F.sum("_n").over(Window.orderBy("_key"))
    return drawn.withColumn("_upto", upto).where(F.expr(f"_upto div {DRAWS} > (_upto - _n) div {DRAWS}")).select("_key")


def _range_of(key: Column, boundaries: Column, most: int) -> Column:
    """How many sorted boundaries are at or below the key: a binary search in log2(most) steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size(boundaries)) & (F.get(boundaries, at + step - 1) <= key), at + step).otherwise(at))


def _dealt(rows: DataFrame, boundaries: DataFrame, most: int) -> DataFrame:
    listed = boundaries.agg(F.array_sort(F.collect_set("_key")).alias("_all"))
    d = rows.withColumn("_bounds", listed.scalar())
    return d.withColumn("_range", _range_of(F.col("_key"), F.col("_bounds"), most)).drop("_bounds")


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes (none for null) plus 1. Shards are cut where the running
    bytes pass each ``1 / shards`` of the total, so sizes differ by less than a document's size;
    equal texts lie together, but for a group that a cut divides. ``slot`` numbers a shard's rows
    from 0. ``grown_shard`` is null under this law. Null ids come first among equal texts; rows that
    repeat are told apart by a tag that is fixed before anything depends on it. Other columns of
    ``docs`` are not read; an empty table gives an empty result.
    """
    d = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tag"),
    )
    least = F.lit(-(1 << 63)).cast("long")
    d = cut(d.withColumn("_key", F.struct("text_crc32", F.coalesce("doc_id", least).alias("id"), "_tag")).drop("_tag"))
    rows, total = d.agg(F.count("*"), F.sum("size")).first()
    ranges = min(MOST_RANGES, max(1, (rows or 0) // PER_RANGE))
    step = (total or 1) / ranges
    first = cut(_boundaries(d, step, "first"))
    counted = _dealt(d, first, 2 * MOST_RANGES).groupBy("_range").agg(F.sum("size").alias("_bytes"))
    over = counted.where(F.col("_bytes") > OVERFULL * step).agg(F.collect_set("_range").alias("_all"))
    inside = _dealt(d, first, 2 * MOST_RANGES).where(F.array_contains(over.scalar(), F.col("_range")))
    both = cut(first.unionByName(_boundaries(inside, step, "again")))
    d = _dealt(d, both, 4 * MOST_RANGES)
    totals = d.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows")
    )
    within = Window.partitionBy("_range").orderBy("_key")
    d = d.withColumn("_at", F.sum("size").over(within) - F.col("size")).withColumn("_nth", F.row_number().over(within) - 1)
    d = d.join(F.broadcast(offsets), "_range")  # a row per range: 4 * MOST_RANGES at most
    place = F.expr(f"cast((2 * cast(_at + _bytes as decimal(38)) + size) * {shards} div {2 * max(total or 1, 1)} as int)")
    d = cut(d.select("doc_id", "size", "text_crc32", place.alias("shard"), (F.col("_rows") + F.col("_nth")).alias("_rank")))
    firsts = d.groupBy("shard").agg(F.min("_rank").alias("_first"))
    d = d.join(F.broadcast(firsts), "shard")  # a row per shard
    return d.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_rank") - F.col("_first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write ``docs``, all its columns, as parquet with one folder per shard.

    Texts meet their places by (doc_id, size, crc32), which a document's repeats share: those take the
    places in the order of a hash of all their columns. The folders are named ``shard``, with an
    underscore more for as long as ``docs`` has such a column. A null text takes one byte; an empty
    table writes no rows.
    """
    places = shard(docs, shards, doc_id, text).select("doc_id", "size", "text_crc32", "shard", "slot")
    keys = ["_id", "_size", "_crc", "_nth"]
    nth = lambda order: F.row_number().over(Window.partitionBy("_id", "_size", "_crc").orderBy(order))
    places = places.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard"), "slot").withColumn("_nth", nth(F.struct("_shard", "slot")))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(doc_id).alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"))
    d = d.withColumn("_nth", nth(row_hash(docs))).alias("a").join(places.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    d.select("_doc.*", F.col("_shard").alias(name)).write.mode("overwrite").partitionBy(name).parquet(path)
