"""Tables, checkpoints, fold files and run results."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def register_views(spark: SparkSession, base: str, names: list[str]) -> dict[str, DataFrame]:
    """Temporary views over ``base/name.parquet``, for catalog SQL."""
    found = {n: spark.read.parquet(f"{base}/{n}.parquet") for n in names}
    for n, d in found.items():
        d.createOrReplaceTempView(n)
    return found


def columns_of(spark: SparkSession, view: str) -> list[str]:
    """Column names from the catalog; no job."""
    return spark.table(view).columns


def checkpoint_table(d: DataFrame, path: str, partition: list[str] | None = None) -> DataFrame:
    """``d`` written over ``path`` and read back: a cut in the plan that other sessions can use."""
    writer = d.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return d.sparkSession.read.parquet(path)


def write_csv(d: DataFrame, path: str, single: bool = False) -> None:
    (d.coalesce(1) if single else d).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV with a header; types come from ``schema``, or are inferred without one."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def catalog_sql(spark: SparkSession, text: str, frames: dict[str, DataFrame] | None = None, **values) -> DataFrame:
    """SQL over views, and over ``frames`` as {name}; ``values`` bind to :name, never by pasting text."""
    return spark.sql(text, args=values or None, **(frames or {}))


def write_tables(tables: dict[str, DataFrame], root: str, form: str = "parquet") -> None:
    """A folder per table below ``root``: the artifacts of a selection, or exported predictions."""
    for name, d in tables.items():
        d.write.mode("overwrite").format(form).option("header", True).save(f"{root}/{name}")


def _file(spark: SparkSession, path: str):
    """The file system that ``path`` names, and the path, as Hadoop sees them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written aside and renamed, so that a reader never sees half of it; any store that Spark writes."""
    fs, where = _file(spark, path)
    aside = _file(spark, f"{path}.tmp")[1]
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    if not fs.rename(aside, where):
        raise OSError(f"cannot rename {aside} to {where}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None where there is none."""
    fs, where = _file(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    data = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    stream.close()
    return data.decode()


def write_fold(splits: DataFrame, fold, root: str, features: list[str], extra: dict | None = None) -> str:
    """One fold: parquet by split, its metadata and its selected features, in one store; gives its folder."""
    spark, folder = splits.sparkSession, f"{root}/{fold.category}/{fold.name}"
    splits.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/panel")
    save_json(spark, f"{folder}/fold_metadata.json", asdict(fold) | (extra or {}))
    write_text(spark, f"{folder}/selected_features.txt", "\n".join(features))
    return folder


def discover_folds(spark: SparkSession, root: str) -> list[dict]:
    """The metadata of all folds below ``root``, in order of category and name."""
    fs, pattern = _file(spark, f"{root}/*/fold_*/fold_metadata.json")
    paths = sorted(x.getPath().toString() for x in fs.globStatus(pattern) or [])
    return [load_json(spark, p) | {"path": p.rsplit("/", 1)[0]} for p in paths]


def load_results(spark: SparkSession, root: str) -> DataFrame:
    """fold_result.json of every fold below ``root`` as rows, with ``fold`` from its folder."""
    d = spark.read.option("multiLine", True).json(f"{root}/*/fold_result.json")
    return d.withColumn("fold", F.regexp_extract(F.input_file_name(), r"(fold_\d+)/fold_result\.json$", 1))


def save_json(spark: SparkSession, path: str, data: dict) -> None:
    write_text(spark, path, json.dumps(data, default=str))


def load_json(spark: SparkSession, path: str, fingerprint: str | None = None) -> dict | None:
    """A checkpoint, or None if there is none or it is of other inputs."""
    text = read_text(spark, path)
    found = json.loads(text) if text else None
    return found if found is None or fingerprint is None or found.get("fingerprint") == fingerprint else None


def entities(d: DataFrame, entity: str, sector: str | None = None, wanted: list[str] | None = None) -> DataFrame:
    """The distinct entities, of some sectors if ``wanted``."""
    d = d.where(F.col(sector).isin(*wanted)) if sector and wanted else d
    return d.select(entity).distinct()
