"""Cutting lineage through the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="plumbline-")
    return _local_folders[application]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


_ARROW = {
    "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "map<string, double>": pa.map_(pa.string(), pa.float64()),
    "map<string, string>": pa.map_(pa.string(), pa.string()),
}


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver holds, as part of the plan: no task reads them from Python.  ``schema``
    has simple types and maps of them, with ``;`` between the columns."""
    fields = [tuple(column.strip().split(" ", 1)) for column in schema.split(";")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [
        pa.array([list(v.items()) if isinstance(v, dict) else v for v in column], _ARROW[kind])
        for column, (_, kind) in zip(columns, fields)
    ]
    ddl = ", ".join(f"{name} {kind}" for name, kind in fields)
    return spark.createDataFrame(pa.Table.from_arrays(arrays, [name for name, _ in fields]), ddl)


def settle(
    df: DataFrame,
    label: str,
    compression: str = "snappy",
    row_group: int | None = None,
    large_rows: bool = False,
) -> DataFrame:
    """Write ``df`` once and read it back, so that later passes prune columns and a lost
    executor costs a re-read instead of the shuffles behind it.

    A task reads no less than a row group.  Where few tasks write much, ``row_group`` bytes at
    most let many tasks read it.  Parquet looks at the size of a row group and of a page after a
    hundred rows; ``large_rows`` lets it look after each, so that rows of a MB do not make a page,
    and buffers of that size, of all that a task writes."""
    path = new_path(df.sparkSession, label)
    writer = df.write.option("compression", compression)
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    if large_rows:
        writer = writer.option("parquet.page.size.row.check.min", 1)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
