"""Sinks: event logs, named snapshots, alerts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.session import materialise
from lintlake.sources.store import Store


def append(df: DataFrame, path: str) -> None:
    """K1: add rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def save_snapshot(df: DataFrame, path: str, snapshot_id: str) -> None:
    """K2: replace one named snapshot, also by no rows; the others stay, and readers see the old one or the new one."""
    Store(df.sparkSession, path).save(snapshot_id, df)


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """M9: the named snapshots of a store with their row counts."""
    return spark.createDataFrame(list(Store(spark, path).rows().items()), "snapshot_id string, n long")


def get_snapshot(spark: SparkSession, path: str, snapshot_id: str) -> DataFrame:
    """M9: the rows of one named snapshot; no rows and no columns but ``snapshot_id`` if there is no such name."""
    rows = Store(spark, path).read(snapshot_id)
    return spark.createDataFrame([], "snapshot_id string") if rows is None else rows.withColumn("snapshot_id", F.lit(snapshot_id))


def all_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """M9: the rows of all snapshots, with their names."""
    return Store(spark, path).read_all("snapshot_id")


def delete_snapshot(spark: SparkSession, path: str, snapshot_id: str) -> bool:
    """M9: delete one named snapshot; whether there was one."""
    return Store(spark, path).delete(snapshot_id)


def panics(events: DataFrame) -> DataFrame:
    """K3: the rows that raise an alert."""
    return events.filter(F.col("status") == "PANIC")


def write_report(findings: DataFrame, path: str) -> None:
    """K4: one JSON row for the summary and one per finding. Both read the findings, so they are found once and written."""
    findings = materialise(findings, "findings")
    levels = findings.groupBy("level").agg(F.count("*").alias("n"))
    summary = levels.select(
        F.lit("summary").alias("kind"), F.to_json(F.struct("level", "n")).alias("body")
    )
    rows = findings.select(F.lit("finding").alias("kind"), F.to_json(F.struct(*findings.columns)).alias("body"))
    summary.unionByName(rows).write.mode("errorifexists").json(path)
