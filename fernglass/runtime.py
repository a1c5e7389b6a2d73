"""Session helpers: where intermediate results live, and how lineage is cut.

A result that an iterative plan reads again is written as parquet into the
folder of ``spark.checkpoint.dir``, which all executors share; losing an
executor then costs a re-read, never a wrong or missing row. Where that setting
is absent (unit tests on one machine) a temporary folder is used instead, and
only there.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000  # rows of a few columns each that may be broadcast

_LOCAL_ROOT: str | None = None
_SHIPPED: set[str] = set()


def session(app: str = "fernglass", cpus: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(max(n, 8)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FERNGLASS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables."""
    global _LOCAL_ROOT
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="fernglass-")
        atexit.register(shutil.rmtree, _LOCAL_ROOT, True)
    return "file://" + _LOCAL_ROOT


def _filesystem(spark: SparkSession, path: str):
    """(path, its file system) as Hadoop has them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared one; it goes when the driver's JVM ends, since results may be read until then."""
    hadoop, fs = _filesystem(spark, f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}")
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return fs.makeQualified(hadoop).toString()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written here go as soon as it is written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here. ``codec`` is for large tables."""
    spark = df.sparkSession
    path = scratch(spark, "table")
    with shuffles_dropped(spark):
        df.write.mode("overwrite").parquet(path, compression=codec)
    # the schema is given, so no file is opened to infer it and an empty table keeps its columns
    out = spark.read.schema(df.schema).parquet(path)
    out._fernglass_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete tables of :func:`materialize` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_fernglass_path", None)
        if path:
            hadoop, fs = _filesystem(df.sparkSession, path)
            fs.delete(hadoop, True)
            df._fernglass_path = None


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it holds at most ``rows`` rows; beyond that, the optimizer joins it as it likes.

    For narrow tables (a few ids or numbers a row) that are cheap to count, such as
    those of :func:`materialize`.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="fernglass-code-")
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/fernglass.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f"fernglass/{f.relative_to(here)}")
    spark.sparkContext.addPyFile(f"{folder}/fernglass.zip")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
