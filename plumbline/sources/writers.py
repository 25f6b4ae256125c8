"""Writing cleaned tables, results and reports (SNK1, SNK2, SNK4)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted
from plumbline.sources.readers import FORMATS


# Partition names of writes that hold many tables or reports.
EXPORTED, REPORTED = "export", "report"


def export_name(run_id: int | None, kind: str) -> str:
    key = str(run_id) if run_id else uuid.uuid4().hex[:10]
    return f"cleaned_{key}.{kind}"


def download_name(filename: str, kind: str) -> str:
    return f"{filename.rsplit('.', 1)[0]}_cleaned.{kind}"


def export_table(cleaned: DataFrame, folder: str, run_id: int | None, kind: str = "csv") -> str:
    """SNK1: the cleaned table as a folder of part files with a header each, no row key."""
    if kind not in FORMATS:
        raise ValueError(f"unknown export format: {kind}")
    path = f"{folder.rstrip('/')}/{export_name(run_id, kind)}"

    _exported(cleaned, kind).mode("overwrite").save(path)
    return path


def _exported(table: DataFrame, kind: str, whole: tuple[str, ...] = ()) -> DataFrameWriter:
    def cell(field: T.StructField) -> Column:
        nested = (T.ArrayType, T.MapType, T.StructType)
        if kind == "csv" and isinstance(field.dataType, nested) and field.name not in whole:
            return F.to_json(quoted(field.name)).alias(field.name)
        return quoted(field.name)

    writer = table.select(*[cell(f) for f in table.schema.fields]).write.format(kind)
    return writer.option("header", True).option("escape", '"') if kind == "csv" else writer


def export_tables(
    cleaned: DataFrame, group: str, names: dict[int, str], folder: str, kind: str = "csv"
) -> None:
    """SNK1 for many tables by one write: the rows of each value of ``group`` go to the folder
    ``export=<name>``, which reads like a table's own.  Exports of other names stay."""
    if kind not in FORMATS:
        raise ValueError(f"unknown export format: {kind}")
    files = cleaned.sparkSession.createDataFrame(list(names.items()), f"`{group}` int, `{EXPORTED}` string")
    named = cleaned.join(F.broadcast(files), group).drop(group)
    writer = _exported(named, kind, (EXPORTED,)).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(EXPORTED).save(folder)


def result_json(result: DataFrame) -> DataFrame:
    """SNK2: each result row as one JSON text."""
    return result.select(F.to_json(F.struct(*result.columns)).alias("json"))


def export_json(result: DataFrame, path: str) -> None:
    result.write.mode("overwrite").json(path)


def save_report(report: DataFrame, folder: str, doc_id: str) -> str:
    """SNK4 for a single run: a folder ``doc_id.txt`` with one part file."""
    path = f"{folder.rstrip('/')}/{doc_id}.txt"
    report.select(F.col("text").alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def save_reports(reports: DataFrame, folder: str) -> bool:
    """SNK4 for the runs of a batch by one write: a folder ``report=<doc_id>.txt`` each.  Reports
    of other names stay."""
    name = F.concat("doc_id", F.lit(".txt")).alias(REPORTED)
    files = reports.select(F.col("text").alias("value"), name).repartition(REPORTED)
    writer = files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(REPORTED).text(folder)
    return True
