"""Sources: corpus trees, event logs, log tails and store tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.rules import code_rules as R

EVENT_SCHEMA = (
    "component_id string, status string, duration_ms double, error string, error_type string, traceback string, "
    "ts timestamp, event_id long, context map<string,string>"
)


def read_files(
    spark: SparkSession, root: str, globs: str = "*", skip_dirs: Sequence[str] = R.SKIP_DIRS, snapshot_id: str = "current"
) -> DataFrame:
    """One row per file below ``root``; the first directory is the repo.

    Names are filtered while listing; skipped directories before any content is read.
    """
    raw = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", globs)
        .text(root, wholetext=True)
        .select(
            F.col("value").alias("content"), F.col("_metadata.file_path").alias("_uri"),
            F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("mtime"),
        )
    )
    inside = F.regexp_replace(F.substring_index("_uri", root.rstrip("/") + "/", -1), r"^file:/+", "")
    parts = F.split(inside, "/")
    skipped = F.exists(parts, lambda p: p.isin(*skip_dirs) | p.startswith(".venv"))
    return raw.filter(~skipped).select(
        parts[0].alias("repo"), F.lit(snapshot_id).alias("snapshot_id"),
        F.array_join(F.slice(parts, 2, F.size(parts)), "/").alias("path"),
        F.regexp_extract("_uri", r"\.([^./]+)$", 1).alias("ext"), "content", "size", "mtime",
    )


def read_events(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON-lines events; malformed and blank lines drop out; all, or the newest ``limit``."""
    rows = spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter("component_id IS NOT NULL")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit) if limit else rows


def tail_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """S3: new lines of the text files in a directory as a stream, blank ones dropped."""
    stream = spark.readStream
    lines = (stream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else stream).text(path)
    return lines.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line")).filter("line <> ''")


def table(spark: SparkSession, path: str, **eq) -> DataFrame:
    """Rows of a stored table equal to every given value (pushed down to the scan)."""
    df = spark.read.parquet(path)
    for column, value in eq.items():
        df = df.filter(F.col(column) == value)
    return df
