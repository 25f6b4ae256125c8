"""Run history (SNK3, SRC5, HIS1, HIS2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.versions import BUCKET, Version, VersionedTable

RUN_COLUMNS = (
    "id int, filename string, upload_time timestamp, before_total_rows bigint, "
    "before_missing_pct double, before_duplicate_pct double, before_outlier_pct double, "
    "before_trust_score double, was_cleaned boolean, after_total_rows bigint, "
    "after_missing_pct double, after_duplicate_pct double, after_outlier_pct double, "
    "after_trust_score double, confidence_level string"
)
_STORED = RUN_COLUMNS + ", run_key string"
_NAMES = [column.split()[0] for column in _STORED.split(", ")]
_RECORDED = ("total_rows", "missing_pct", "duplicate_pct", "outlier_pct", "trust_score")
PAGE = 50
# Runs in one file; the unit that a save rewrites and that a look-up opens.
RUNS_PER_BUCKET = 1000


def _table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, _STORED)


def _bucket(run_id: int) -> int:
    return (run_id - 1) // RUNS_PER_BUCKET


def run_rows(result: DataFrame, *also: str) -> DataFrame:
    """History columns, but for the id, of result rows with ``before`` and ``after``."""
    sides = [
        F.col(f"{side}.{name}").alias(f"{side}_{name}")
        for side in ("before", "after")
        for name in _RECORDED
    ]
    return result.select(
        "filename",
        F.col("created_at").alias("upload_time"),
        *sides[: len(_RECORDED)],
        "was_cleaned",
        *sides[len(_RECORDED) :],
        "confidence_level",
        *also,
    )


def save_runs(results: DataFrame, path: str) -> dict[str, int]:
    """SNK3: stores runs, named by their column ``run_key``, and returns the id of each key.

    ``results`` has one row per run of a batch.  A key that is stored already, as when a
    micro-batch is repeated, replaces its row and keeps its id; others get the next ids, by time
    and key.  Writers may save at the same time: ids are claimed with the version that holds
    them, and who comes second claims others."""
    spark = results.sparkSession
    table = _table(spark, path)
    rows = run_rows(results, "run_key")
    # The rows of one batch, computed once however often the claim is tried.
    taken = rows.orderBy("upload_time", "run_key").collect()
    new = spark.createDataFrame(taken, rows.schema)
    keys = [row.run_key for row in taken]
    if len(set(keys)) < len(keys) or None in keys:
        raise ValueError("every run of a batch needs a key of its own")

    def attempt(version: Version):
        known = table.rows(version).where(F.col("run_key").isin(keys)).select("run_key", "id")
        ids = {row.run_key: row.id for row in known.collect()} if version.parts else {}
        last = version.facts.get("last_id", 0)
        for key in keys:
            if key not in ids:
                last += 1
                ids[key] = last
        numbers = spark.createDataFrame([(key, ids[key]) for key in keys], "run_key string, id int")
        mine = new.join(F.broadcast(numbers), "run_key").select(*_NAMES)
        touched = {_bucket(ids[key]) for key in keys}
        others = table.rows(version, touched).where(~F.col("id").isin([ids[key] for key in keys]))
        whole = others.unionByName(mine)
        number = F.floor((F.col("id") - 1) / RUNS_PER_BUCKET).cast("int")
        written = table.write(whole.withColumn(BUCKET, number).repartition(BUCKET))
        return written, {"last_id": last}, ids

    return table.change(attempt) if keys else {}


def save_run(result: DataFrame, path: str, run_key: str) -> int:
    """SNK3: stores one run under its key and returns its id."""
    return save_runs(result.withColumn("run_key", F.lit(run_key)), path)[run_key]


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """SRC5: all runs; none before the first is saved."""
    table = _table(spark, path)
    return table.rows(table.latest()).drop("run_key")


def find_run(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    """HIS2: one row or none; only the file that may hold the run is opened."""
    table = _table(spark, path)
    return run_by_id(table.rows(table.latest(), {_bucket(run_id)}).drop("run_key"), run_id)


def latest_runs(history: DataFrame, limit: int = PAGE) -> DataFrame:
    """HIS1: a page of the newest runs; the id orders runs of the same moment."""
    return history.orderBy(F.desc("upload_time"), F.desc("id")).limit(limit)


def run_by_id(history: DataFrame, run_id: int) -> DataFrame:
    """HIS2, PRJ8: one row or none; the filter reaches the file."""
    return history.where(F.col("id") == run_id)


def shown(history: DataFrame) -> DataFrame:
    """PRJ10: times as text and flags as booleans."""
    return history.withColumn(
        "upload_time", F.date_format("upload_time", "yyyy-MM-dd HH:mm:ss")
    ).withColumn("was_cleaned", F.col("was_cleaned").cast("boolean"))
