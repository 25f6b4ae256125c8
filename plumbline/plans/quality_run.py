"""One full run over a table: measure, score, repair, measure again, record (PIPE1)."""

from __future__ import annotations

import datetime as dt
import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.limits import DEFAULT_LIMITS, Limits
from plumbline.operators.clean import REPORT_SCHEMA, clean_data, null_counts
from plumbline.operators.distinct import count_distinct_rows
from plumbline.operators.normalize import normalize_missing
from plumbline.operators.profile import TableProfile, fit_profile, quality_metrics, require_rows
from plumbline.operators.reports import build_report, report_metadata, report_name
from plumbline.operators.trust import predict_trust_score
from plumbline.sources.history import save_run
from plumbline.sources.report_index import upsert_reports
from plumbline.sources.writers import download_name, export_table, save_report

_log = logging.getLogger(__name__)

# Fixed value: tables scored below this are cleaned.
TRUST_THRESHOLD = 95.0


@dataclass
class QualityRun:
    """``result`` is one nested row; ``frame`` the table after the run."""

    result: DataFrame
    frame: DataFrame
    was_cleaned: bool
    run_id: int | None
    report_path: str | None
    export_path: str | None
    # Steps of recording that failed, with their errors.
    failures: dict[str, str] = field(default_factory=dict)


class Recording:
    """Recording must not lose a run: a step that fails leaves a note and no result."""

    def __init__(self):
        self.failures: dict[str, str] = {}

    def attempt(self, step: str, action: Callable):
        try:
            return action()
        except Exception as error:  # noqa: BLE001
            _log.warning("%s was not written", step, exc_info=True)
            self.failures[step] = f"{type(error).__name__}: {str(error)[:500]}"
            return None


def indexed(reports: DataFrame) -> DataFrame:
    """Index rows of reports (doc_id, report_path, text, created_at), as REP4 keeps them: the later
    of two reports of one name is the one that counts."""
    version = F.unix_micros(F.col("created_at").cast("timestamp")).alias("version")
    return report_metadata(reports).join(reports.select("doc_id", version), "doc_id")


def needs_cleaning(score: float, threshold: float = TRUST_THRESHOLD) -> bool:
    """PRJ9: strictly below."""
    return score < threshold


def untouched_report(
    df: DataFrame, key: str | None = None, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Audit of a run without cleaning: nulls and copies as they are, markers not counted."""
    rows, nulls = null_counts(df, key)
    missing = sum(nulls.values())
    distinct = count_distinct_rows(df, rows, key, limits).first()[0]
    row = (0, missing, missing, [], [], (missing == 0, distinct == rows))
    return df.sparkSession.createDataFrame([row], REPORT_SCHEMA)


def _measured(profile: TableProfile, scorer: str) -> DataFrame:
    """Metrics and score, computed now: they decide how the run goes on."""
    scored = predict_trust_score(quality_metrics(profile), scorer)
    return scored.sparkSession.createDataFrame([scored.first()], scored.schema)


def run_quality(
    df: DataFrame,
    filename: str,
    key: str | None = None,
    scorer: str = "forest",
    threshold: float = TRUST_THRESHOLD,
    history: str | None = None,
    reports: str | None = None,
    exports: str | None = None,
    export_format: str = "csv",
    run_key: str | None = None,
    created_at: dt.datetime | None = None,
    limits: Limits = DEFAULT_LIMITS,
    index: str | None = None,
) -> QualityRun:
    """Runs all steps; history, report, index and export are written where a folder is given.

    Where the history, the report or the index cannot be written, the run goes on without: its id
    or path stays null and ``failures`` says why.  The driver sees metrics rows and the cleaning
    report, never rows of the table."""
    require_rows(df)
    spark = df.sparkSession
    profile = fit_profile(normalize_missing(df, key), key, limits)
    before = _measured(profile, scorer)
    was_cleaned = needs_cleaning(before.first().trust_score, threshold)
    if was_cleaned:
        cleaning = clean_data(df, key, limits, profile=profile)
        frame, report = cleaning.frame, cleaning.report()
        # The only marker left in the table is the placeholder, so rows that differ still
        # differ once it is read as missing, and the check's count of them holds.
        cleaned = normalize_missing(frame, key)
        after = _measured(fit_profile(cleaned, key, limits, cleaning.distinct_rows), scorer)
    else:
        frame, report, after = df, untouched_report(df, key, limits), before

    moment = created_at or dt.datetime.now()

    def packed(part: DataFrame):
        return part.select(F.struct(*part.columns)).scalar()

    result = spark.range(1).select(
        F.lit("SUCCESS").alias("status"),
        F.lit(filename).alias("filename"),
        F.lit(moment).alias("created_at"),
        F.lit(was_cleaned).alias("was_cleaned"),
        F.lit(float(threshold)).alias("threshold"),
        packed(report).alias("cleaning_report"),
        packed(before).alias("before"),
        packed(after).alias("after"),
    )
    result = result.withColumn("confidence_level", F.col("after.confidence_level"))
    recording = Recording()
    run_id = None
    if history:
        run_id = recording.attempt("history", lambda: save_run(result, history, run_key or uuid.uuid4().hex))
    result = result.withColumn("run_id", F.lit(run_id).cast("int"))
    with_report = build_report(result)
    report_path = None
    named = with_report.select(
        report_name(F.col("run_id"), F.col("filename")).alias("doc_id"),
        F.col("report").alias("text"),
        "created_at",
    )
    if reports:
        report_path = recording.attempt(
            "report", lambda: save_report(named, reports, named.first().doc_id)
        )
    if index:
        located = named.withColumn("report_path", F.lit(report_path).cast("string"))
        recording.attempt("index", lambda: upsert_reports(indexed(located), index))
    export_path = None
    if exports and was_cleaned:
        export_path = export_table(
            frame.drop(key) if key else frame, exports, run_id, export_format
        )
    result = with_report.withColumns(
        {
            "report_path": F.lit(report_path).cast("string"),
            "download_path": F.lit(export_path).cast("string"),
            "download_name": F.lit(
                download_name(filename, export_format) if export_path else None
            ).cast("string"),
        }
    )
    return QualityRun(
        result, frame, was_cleaned, run_id, report_path, export_path, recording.failures
    )
