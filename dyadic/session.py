"""Sessions, tables and the shared folder in which long jobs cut their lineage."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of a missing value in the text columns, next to null.
MISSING = ("", "-", "NA", "nan")


def local_session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("dyadic")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_missing(value: str | Column) -> Column:
    """True for null and for every spelling in MISSING, surrounding blanks aside; never null."""
    c = F.col(value) if isinstance(value, str) else value
    return c.isNull() | F.trim(c).isin(*MISSING)


def ship_package(spark: SparkSession) -> None:
    """Lets the Python workers import this package, wherever they run: an archive of it goes to all executors, once a context."""
    context = spark.sparkContext
    if getattr(context, "_dyadic_archive", None):
        return
    home = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/dyadic-{uuid.uuid4().hex}.zip")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(at)
    out.write(held.getvalue())
    out.close()
    fs.deleteOnExit(at)
    context.addPyFile(at.toString())
    context._dyadic_archive = at.toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in local mode, where nothing is set."""
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    home = Path(tempfile.gettempdir()) / f"dyadic-{os.getpid()}"
    home.mkdir(exist_ok=True)
    return home.as_uri()


class Workspace:
    """Tables written to the shared folder, so that a lost executor costs no more than one step.

    Tables that a later step replaces are dropped at once; those that a returned DataFrame still reads
    go when the JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and gives it back as a scan of what was written."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
