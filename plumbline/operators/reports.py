"""Report texts of runs, their metadata and their index (REP1 to REP4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.bitmap import bitmap_of, mark_members
from plumbline.functions.formats import file_stem, fixed, flag_text, signed
from plumbline.operators.views import clipped_cells
from plumbline.sources.readers import read_reports

# Wording of the report.
TITLE = "Data Quality Cleaning Report"
METRIC_LINES = (
    ("Rows", "total_rows"),
    ("Missing %", "missing_pct"),
    ("Duplicate %", "duplicate_pct"),
    ("Outlier %", "outlier_pct"),
    ("Type inconsistency %", "type_inconsistency_pct"),
    ("Null column ratio %", "null_col_ratio"),
    ("Constant column ratio %", "constant_col_ratio"),
    ("Average skewness", "avg_skewness"),
)
HINT = (
    "Use this report to explain why trust score changed, which cleaning actions were applied, "
    "and what issues remained after processing."
)
NO_REPORT_ACTION = "No structured cleaning report was available."
NO_CORRECTION_ACTION = "Cleaning pipeline completed without major corrections."
PENDING = "pending"
LISTED_IMPUTATIONS = 6

UNKNOWN_RUN = -1


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), value.cast("string"))


def action_lines() -> Column:
    """REP1: what cleaning did, from column ``cleaning_report``."""
    report = F.col("cleaning_report")
    clipped = clipped_cells()
    counts = F.array_compact(
        F.array(
            F.when(
                report.missing_before > report.missing_after,
                F.format_string(
                    "Missing values reduced from %d to %d.",
                    report.missing_before,
                    report.missing_after,
                ),
            ),
            F.when(
                report.duplicates_removed > 0,
                F.format_string("Removed %d duplicate rows.", report.duplicates_removed),
            ),
            F.when(
                clipped > 0, F.format_string("Clipped %d outlier values to IQR bounds.", clipped)
            ),
        )
    )
    fills = F.transform(
        F.slice(report.imputations, 1, LISTED_IMPUTATIONS),
        lambda entry: F.format_string(
            "Column %s used %s (%d values).",
            entry["column"],
            entry["strategy"],
            entry["filled_count"],
        ),
    )
    lines = F.concat(counts, fills)
    return (
        F.when(report.isNull(), F.array(F.lit(NO_REPORT_ACTION)))
        .when(F.size(lines) == 0, F.array(F.lit(NO_CORRECTION_ACTION)))
        .otherwise(lines)
    )


def _metric_block(heading: str, side: str) -> list[Column]:
    return [F.lit(heading)] + [
        _line(label, F.col(f"{side}.{metric}")) for label, metric in METRIC_LINES
    ]


def build_report(runs: DataFrame) -> DataFrame:
    """REP2: adds ``report`` to result rows.

    Columns: run_id, filename, created_at, threshold, was_cleaned, confidence_level, structs
    before and after (metrics and trust_score), cleaning_report (may be null)."""
    before, after = F.col("before.trust_score"), F.col("after.trust_score")
    report = F.col("cleaning_report")
    blank = F.lit("")
    head = F.array(
        F.lit(TITLE),
        _line("Created At", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")),
        _line("Run ID", F.coalesce(F.col("run_id").cast("string"), F.lit(PENDING))),
        _line("Dataset Name", F.col("filename")),
        _line("Trust Threshold", F.col("threshold")),
        _line("Was Cleaned", flag_text(F.col("was_cleaned"))),
        blank,
        F.lit("Trust Score Summary"),
        _line("Before", fixed(before)),
        _line("After", fixed(after)),
        _line("Change", signed(after - before)),
        _line("Confidence Level", F.col("confidence_level")),
        blank,
        *_metric_block("Key Metrics Before", "before"),
        blank,
        *_metric_block("Key Metrics After", "after"),
        blank,
        F.lit("Cleaning Actions"),
    )
    actions = F.transform(action_lines(), lambda action: F.concat(F.lit("- "), action))
    details = F.when(
        report.isNotNull(),
        F.array(
            blank,
            F.lit("Structured Cleaning Details"),
            _line("Duplicates Removed", report.duplicates_removed),
            _line("Missing Before", report.missing_before),
            _line("Missing After", report.missing_after),
            _line("Validation No Missing Values", flag_text(report.validation.no_missing_values)),
            _line("Validation No Duplicate Rows", flag_text(report.validation.no_duplicate_rows)),
        ),
    ).otherwise(F.array().cast("array<string>"))
    tail = F.array(blank, F.lit("Answering Hint"), F.lit(HINT))
    return runs.withColumn("report", F.array_join(F.concat(head, actions, details, tail), "\n"))


def report_name(run_id: Column, filename: Column) -> Column:
    """SNK4, STR3: document id of a run's report."""
    stem = F.replace(file_stem(filename), F.lit(" "), F.lit("_"))
    return F.concat(
        F.lit("run_"), F.coalesce(run_id.cast("string"), F.lit(PENDING)), F.lit("_"), stem
    )


def _last_value(text: Column, label: str) -> Column:
    """Trimmed text after ``label:`` on the last line that starts so, null without one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?m)^{label}:(.*)$"), F.lit(1))
    return F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"(?U)^\s+|\s+$", "")


def report_metadata(reports: DataFrame) -> DataFrame:
    """REP3: (doc_id, text, report_path) gains run_id and filename read from the text."""
    run_text = _last_value(F.col("text"), "Run ID")
    run_id = F.when(run_text.rlike(r"^[+-]?\d+$"), run_text.try_cast("int"))
    return reports.select(
        "doc_id",
        F.coalesce(run_id, F.lit(UNKNOWN_RUN)).alias("run_id"),
        F.coalesce(
            _last_value(F.col("text"), "Dataset Name"), file_stem(F.col("report_path"))
        ).alias("filename"),
        "report_path",
        "text",
    )


def index_reports(spark: SparkSession, folder: str) -> DataFrame:
    """REP4: index rows of all report files in a folder, keyed by the file's stem as saved
    reports are, so that indexing again replaces and does not add."""
    return report_metadata(read_reports(spark, folder))


def upsert_index(index: DataFrame, changes: DataFrame, version: str) -> DataFrame:
    """REP4: the changes replace the rows of their documents; of several changes to one
    document, the one with the highest ``version`` does.

    The index has one row per document.  The changed ids go to the tasks as a bitmap of fixed size:
    rows it does not know stay where they are, and only the few it may know are compared by id."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(version))
    latest = changes.withColumn("__age", F.row_number().over(order)).where("__age = 1").drop("__age")
    digest = F.xxhash64("doc_id")
    known = bitmap_of(changes.select(digest.alias("__digest")), "__digest")
    marked = mark_members(index.withColumn("__digest", digest), "__digest", known, "__maybe").drop("__digest")
    stay = marked.where("NOT __maybe").drop("__maybe")
    rest = marked.where("__maybe").drop("__maybe").join(changes.select("doc_id").distinct(), "doc_id", "left_anti")
    return stay.unionByName(rest).unionByName(latest)
