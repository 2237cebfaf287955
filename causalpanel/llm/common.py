"""Helpers that several operators share: words, row identity, lineage cuts, prefix sums."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causalpanel.session import checkpoint_dir, cut, ship

__all__ = ["bucket_offsets", "checkpoint_dir", "cut", "discard", "hash_bits", "keyed", "n_words", "row_hash", "row_key", "ship", "stored", "words"]

#: A word is a maximal run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: The columns that every pipeline stage but the last hands on.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read again.

    A checkpoint keeps its plan's size estimate, which joins multiply; over many rounds it grows to
    numbers whose products take the driver minutes. A stored table has the size of its files.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def row_key(*columns: Column) -> list[Column]:
    """Two 64-bit hashes that name a row by ``columns``; nulls are told from values."""
    flags = [c.isNull() for c in columns]
    return [
        F.xxhash64(*columns, *flags).alias("_k1"),
        F.xxhash64(F.lit("second"), *columns, *flags).alias("_k2"),
    ]


def keyed(docs: DataFrame, *names: str) -> DataFrame:
    """_doc (the whole row, whatever its columns are called), _k1, _k2 (its key by ``names``)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    return docs.select(whole, *row_key(*[F.col(n) for n in names]))


def row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row in ``_doc``, for an order among rows that share their keys (maps count as equal)."""
    kept = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return F.xxhash64(*[F.col(f"_doc.`{c}`") for c in kept])


def hash_bits(rows: int, per_bucket: int, most: int = 40) -> int:
    """Bits of a uniform hash that cut ``rows`` rows into buckets of about ``per_bucket``."""
    return min(most, max(0, math.ceil(math.log2(max(rows, 1) / per_bucket))))


def bucket_offsets(totals: DataFrame, keys: list[str], bucket: str, bits: int, value: str) -> DataFrame:
    """Exclusive prefix sums of ``value`` over ``bucket`` within ``keys``, in two levels.

    ``totals`` has one row per (keys, bucket). The upper half of the bucket's bits makes
    super-buckets, so that no window holds more than about the square root of all buckets.
    """
    low = bits // 2
    wide = totals.withColumn("_super", F.shiftright(bucket, low))
    tops = wide.groupBy(*keys, "_super").agg(F.sum(value).alias("_sum"))
    by_key = Window.partitionBy(*keys).orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_super", F.coalesce(F.sum("_sum").over(by_key), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys, "_super").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return wide.join(tops, [*keys, "_super"]).select(
        *keys, bucket, (F.col("_before") + F.col("_within")).alias("_offset")
    )
