"""Session factory and access to the shared driver tables."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with AQE on, ANSI left on and UTC times (tests and bench)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("causalpanel")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CAUSALPANEL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session's context."""
    context = spark.sparkContext
    if getattr(context, "_causalpanel_shipped", False):
        return
    package = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="causalpanel-")) / "causalpanel.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(packed))
    context._causalpanel_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a temporary one; a cluster gets an error, since its
    executors would not find what lies in the driver's own folder.
    """
    context = spark.sparkContext
    holder = context._jsc.sc()
    if holder.getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="causalpanel-"))
    return holder.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised once in the shared checkpoint folder, with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of ``sf_dir`` (any path Spark's readers can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
