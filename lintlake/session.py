"""Session defaults and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_MADE: list[str] = []
_SHIPPED: set[str] = set()


def build_session(app: str = "lintlake", cpus: int | str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The folder that all nodes share (``spark.checkpoint.dir``). Only a local session may do without: it gets a temporary one,
    which is deleted at its end."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return _LOCAL_DIRS[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the work folder; never reused, so a table is never read and overwritten at once."""
    path = os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _MADE.append(path)
    return path


def clean_work(spark: SparkSession) -> None:
    """Delete the tables that this process put into the work folder; for the end of a job, when no result is read any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while _MADE:
        path = hadoop.Path(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder, so lost executors never recompute the past rounds."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once; they need no path of their own then."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, os.path.basename(package) + ".zip")
    with zipfile.ZipFile(archive, "w") as out:
        for top, _, names in os.walk(package):
            for name in (n for n in names if n.endswith(".py")):
                path = os.path.join(top, name)
                out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
