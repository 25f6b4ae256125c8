"""Full runs over all files of a batch at once: measure, score, repair, measure again, record (STM1)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.limits import DEFAULT_LIMITS, Limits
from plumbline.operators.clean import REPORT_SCHEMA
from plumbline.operators.grouped import (
    GROUP,
    clean_groups,
    fit_grouped_profile,
    grouped_metrics,
)
from plumbline.operators.normalize import normalize_missing
from plumbline.operators.profile import total
from plumbline.operators.reports import build_report, report_name
from plumbline.operators.trust import predict_trust_score
from plumbline.plans.quality_run import TRUST_THRESHOLD, Recording, indexed, needs_cleaning
from plumbline.sources.history import save_runs
from plumbline.sources.report_index import upsert_reports
from plumbline.sources.writers import (
    EXPORTED,
    REPORTED,
    download_name,
    export_name,
    export_tables,
    save_reports,
)
from plumbline.storage import settle

FILE = "__file"
# Bytes of a row group of the stored batch: a few large files are read by a task each, later passes
# by many.
ROW_GROUP = 4 << 20


@dataclass
class BatchRun:
    """``results`` has one nested row per file, as ``QualityRun.result`` has one; ``frame`` the
    rows after the run with their file's number."""

    results: DataFrame
    frame: DataFrame | None
    run_ids: dict[str, int]
    failures: dict[str, str]


def _scored(metrics: DataFrame, scorer: str) -> list:
    return predict_trust_score(metrics, scorer).collect()


def run_quality_batch(
    df: DataFrame,
    key: str | None = None,
    scorer: str = "forest",
    threshold: float = TRUST_THRESHOLD,
    history: str | None = None,
    reports: str | None = None,
    exports: str | None = None,
    export_format: str = "csv",
    run_key: str = "batch",
    created_at: dt.datetime | None = None,
    limits: Limits = DEFAULT_LIMITS,
    index: str | None = None,
) -> BatchRun:
    """One run for each value of the column ``__file``, a path; its last part names the run.

    All files share each pass, so the number of jobs does not grow with the number of files.  Files
    without rows have no run.  The run of a file is recorded under ``run_key`` and its path, so
    that a repeated batch replaces its runs.  Cleaned files are exported next to each other by one
    write.  What cannot be recorded is told in ``failures``."""
    spark = df.sparkSession
    paths = [row[0] for row in df.select(FILE).distinct().orderBy(FILE).collect()]
    if not paths:
        return BatchRun(spark.createDataFrame([], "filename string"), None, {}, {})
    numbers = spark.createDataFrame(list(zip(paths, range(len(paths)))), f"{FILE} string, {GROUP} int")
    # Read and typed once; the passes take their columns from here.
    numbered = settle(df.join(F.broadcast(numbers), FILE).drop(FILE), "batch", row_group=ROW_GROUP)
    profile = fit_grouped_profile(normalize_missing(numbered, key), key, limits)
    before = {row[GROUP]: row for row in _scored(grouped_metrics(profile), scorer)}
    cleaned = {part for part, row in before.items() if needs_cleaning(row.trust_score, threshold)}
    audits, after, frame = {}, dict(before), None
    if cleaned:
        repaired = clean_groups(profile, cleaned, limits)
        frame, audits = repaired.frame, repaired.audits
        again = fit_grouped_profile(normalize_missing(frame, key), key, limits, repaired.copies)
        after |= {row[GROUP]: row for row in _scored(grouped_metrics(again), scorer)}
    if untouched := set(before) - cleaned:
        # Nulls and copies as they are, markers not counted.
        names = [name for name in numbered.columns if name not in (GROUP, key)]
        rest = numbered.where(F.col(GROUP).isin(sorted(untouched)))
        raw = fit_raw_audit(rest, names, key, limits)
        audits |= {part: (0, n, n, [], [], (n == 0, unique)) for part, (n, unique) in raw.items()}

    moment = created_at or dt.datetime.now()
    side = [name for name in before[0].__fields__ if name != GROUP]
    metrics_type = predict_trust_score(grouped_metrics(profile).limit(0), scorer).drop(GROUP).schema
    rows = [
        (
            "SUCCESS", paths[part].rstrip("/").rpartition("/")[2], moment, part in cleaned, float(threshold),
            audits[part], tuple(before[part][name] for name in side), tuple(after[part][name] for name in side),
            f"{run_key}:{paths[part]}", part,
        )
        for part in sorted(before)
    ]
    # One row per file.
    results = spark.createDataFrame(
        rows,
        "status string, filename string, created_at timestamp, was_cleaned boolean, threshold double, "
        f"cleaning_report struct<{REPORT_SCHEMA}>, before {metrics_type.simpleString()}, "
        f"after {metrics_type.simpleString()}, run_key string, {GROUP} int",
    ).withColumn("confidence_level", F.col("after.confidence_level"))

    recording = Recording()
    ids = recording.attempt("history", lambda: save_runs(results, history)) if history else None
    ids = ids or {}
    told = [(row[-2], row[-1], ids.get(row[-2]), row[1]) for row in rows]
    numbers = spark.createDataFrame([(k, i) for k, _, i, _ in told], "run_key string, run_id int")
    with_report = build_report(results.join(F.broadcast(numbers), "run_key"))
    named = with_report.select(
        report_name(F.col("run_id"), F.col("filename")).alias("doc_id"), F.col("report").alias("text"), "created_at", "run_key"
    )
    # Files of one name in different folders are told apart where there is no id.
    place = F.lit(None).cast("string")
    if reports and recording.attempt("report", lambda: save_reports(named, reports)):
        place = F.concat(F.lit(f"{reports.rstrip('/')}/{REPORTED}="), F.col("doc_id"), F.lit(".txt"))
    located = named.withColumn("report_path", place)
    if index:
        recording.attempt("index", lambda: upsert_reports(indexed(located.drop("run_key")), index))
    links = [(k, None, None) for k, *_ in told]
    if exports and frame is not None:
        files = {part: export_name(i, export_format) for _, part, i, _ in told if part in cleaned}
        export_tables(frame.drop(key) if key else frame, GROUP, files, exports, export_format)
        links = [
            (k, f"{exports.rstrip('/')}/{EXPORTED}={files[part]}", download_name(name, export_format))
            if part in files
            else (k, None, None)
            for k, part, _, name in told
        ]
    results = (
        with_report.join(located.select("run_key", "report_path"), "run_key")
        .join(spark.createDataFrame(links, "run_key string, download_path string, download_name string"), "run_key")
        .drop(GROUP)
    )
    return BatchRun(results, frame, ids, recording.failures)


def fit_raw_audit(
    rows: DataFrame, names: list[str], key: str | None, limits: Limits = DEFAULT_LIMITS
) -> dict[int, tuple[int, bool]]:
    """Per table as it came: null cells, and whether no row is there twice."""
    from plumbline.operators.distinct import find_duplicates

    counted = rows.groupBy(GROUP).agg(
        F.count("*").alias("rows"), total(F.count_if(quoted(name).isNull()) for name in names).alias("missing")
    ).collect()
    copies = find_duplicates(rows, sum(row.rows for row in counted), key, limits).copies_by(GROUP)
    return {row[GROUP]: (row.missing, copies.get(row[GROUP], 0) == 0) for row in counted}
