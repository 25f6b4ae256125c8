"""Reading tables and report texts (SRC1, SRC2, SRC4)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.functions.formats import file_stem
from plumbline.functions.tokens import FILE_NULL_WORDS, is_number
from plumbline.sources.csv_ranges import read_quoted_csv
from plumbline.storage import settle

FORMATS = ("csv", "parquet", "json")

_INTEGER = r"^\s*[+-]?\d+\s*$"
_BOOLEANS = ("true", "false")
_REPORT_SCHEMA = "doc_id string, report_path string, text string"


def _csv_text(
    spark: SparkSession, path: str, separator: str, multiline: bool
) -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("inferSchema", False)
        .csv(path)
    )


def _known(value: Column) -> Column:
    """NULL for the words a file uses for an absent value."""
    return F.when(~value.isin(*FILE_NULL_WORDS), value)


def infer_types(text: DataFrame) -> DataFrame:
    """Types for a table of strings: a column is numeric or boolean if all its values are.

    Dates stay text.  One scan decides for all columns; whole numbers without gaps become
    longs, other numbers doubles."""
    known = text.select(*[_known(quoted(name)).alias(name) for name in text.columns])
    checks = [F.count("*").alias("rows")]
    for place, name in enumerate(text.columns):
        value = quoted(name)
        checks += [
            F.count(value).alias(f"n{place}"),
            F.count_if(is_number(value)).alias(f"number{place}"),
            F.count_if(
                value.rlike(_INTEGER) & value.try_cast("bigint").isNotNull()
            ).alias(f"whole{place}"),
            F.count_if(F.lower(value).isin(*_BOOLEANS)).alias(f"flag{place}"),
        ]
    row = known.agg(*checks).first()

    def typed(place: int, name: str) -> Column:
        value, present = quoted(name), row[f"n{place}"]
        if present == row[f"number{place}"]:
            whole = present == row["rows"] and present == row[f"whole{place}"]
            return F.trim(value).try_cast("bigint" if whole else "double").alias(name)
        if present == row[f"flag{place}"]:
            return value.try_cast("boolean").alias(name)
        return value

    return known.select(*[typed(place, name) for place, name in enumerate(text.columns)])


def read_csv(
    spark: SparkSession, path: str, separator: str = ",", multiline: bool = False
) -> DataFrame:
    """SRC1.  ``multiline`` allows line breaks inside quotes; the files are then read by ranges,
    many tasks to a file, and kept as Parquet for the passes that follow."""
    if not multiline:
        return infer_types(_csv_text(spark, path, separator, False))
    names = _csv_text(spark, path, separator, True).columns
    return infer_types(read_quoted_csv(spark, path, names, separator))


def table_format(path: str) -> str:
    """SRC2: the format named by the suffix, in any case."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in FORMATS:
        raise ValueError(f"only {', '.join(FORMATS)} tables are supported: {path}")
    return suffix


def read_table(spark: SparkSession, path: str, stage: bool = False) -> DataFrame:
    """SRC2: a table by its suffix.  ``stage`` writes row-oriented text once as Parquet,
    which pays when many passes follow, since each then reads only its columns."""
    kind = table_format(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    df = read_csv(spark, path) if kind == "csv" else spark.read.json(path)
    return settle(df, "staged") if stage else df


def report_names(reports: DataFrame) -> DataFrame:
    """SRT2: (doc_id, report_path) in the order of names; the texts are not read for it."""
    return reports.select("doc_id", "report_path").orderBy("doc_id")


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """SRC4: (doc_id, report_path, text) of all ``.txt`` files, in no order; none if the folder
    is missing."""
    try:
        files = (
            spark.read.option("pathGlobFilter", "*.txt")
            .option("recursiveFileLookup", True)
            .text(folder, wholetext=True)
        )
    except AnalysisException:
        return spark.createDataFrame([], _REPORT_SCHEMA)
    path = F.col("_metadata.file_path")
    # A report written by Spark is a folder of that name with one part file, whose last line
    # end is the writer's.
    part = r"\.txt/part-[^/]*$"
    report = F.regexp_replace(path, part, ".txt")
    text = F.when(path.rlike(part), F.regexp_replace("value", r"\n\z", "")).otherwise(F.col("value"))
    # Reports of a batch are partitions of one write, whose names are escaped.
    stem = file_stem(report)
    doc_id = F.when(stem.startswith("report="), F.try_url_decode(F.substring_index(stem, "report=", -1))).otherwise(stem)
    return files.select(
        doc_id.alias("doc_id"), report.alias("report_path"), text.alias("text")
    )
