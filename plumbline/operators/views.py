"""Measures derived for display from metrics and runs (VIEW1 to VIEW9, SRT1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.formats import grouped_digits, one_decimal

# Lowest score of each grade and band.
GRADES = ((92, "A+"), (80, "A"), (68, "B"), (55, "C"), (40, "D"))
LOWEST_GRADE = "F"
BANDS = ((75, "good"), (50, "fair"))
LOWEST_BAND = "poor"

# Display names of the metrics that cleaning can improve.
IMPROVABLE = {
    "missing_pct": "Missing values",
    "duplicate_pct": "Duplicate rows",
    "outlier_pct": "Outliers (IQR)",
    "type_inconsistency_pct": "Type inconsistency",
    "null_col_ratio": "Null columns",
    "constant_col_ratio": "Constant columns",
}

# Display names of the radar axes.
DIMENSIONS = {
    "completeness": "missing_pct",
    "uniqueness": "duplicate_pct",
    "validity": "outlier_pct",
}


def _first_step(value: Column, steps: tuple, otherwise: str) -> Column:
    branches = F.lit(otherwise)
    for bound, name in reversed(steps):
        branches = F.when(value >= bound, name).otherwise(branches)
    return branches


def health_grade(score: Column) -> Column:
    """VIEW1."""
    return _first_step(score, GRADES, LOWEST_GRADE)


def score_band(score: Column) -> Column:
    """VIEW2."""
    return F.when(score.isNotNull(), _first_step(score, BANDS, LOWEST_BAND))


def quality_dimensions(metrics: DataFrame) -> DataFrame:
    """VIEW3: what is left of 100 after each share of bad cells or rows."""
    return metrics.select(
        "*",
        *[
            F.greatest(F.lit(0.0), 100.0 - F.coalesce(F.col(metric), F.lit(0.0))).alias(name)
            for name, metric in DIMENSIONS.items()
        ],
    )


def metric_trend(before: Column, after: Column) -> Column:
    """VIEW4: struct of direction and label, null when a side is unknown."""
    change = after - before
    shown = F.format_string("%.1f", one_decimal(F.abs(change)))
    down = F.struct(F.lit("down").alias("direction"), F.concat(F.lit("−"), shown, F.lit("%")).alias("label"))
    up = F.struct(F.lit("up").alias("direction"), F.concat(F.lit("+"), shown, F.lit("%")).alias("label"))
    flat = F.struct(F.lit("flat").alias("direction"), F.lit("±0%").alias("label"))
    return F.when(change < -0.5, down).when(change > 0.5, up).when(change.isNotNull(), flat)


def severity(pct: Column) -> Column:
    """VIEW5 for one metric."""
    return F.when(pct > 20, "high").when(pct > 5, "medium").otherwise("low")


def overall_severity(metrics: tuple[Column, ...]) -> Column:
    """VIEW5 for the mean of several metrics."""
    filled = [F.coalesce(metric, F.lit(0.0)) for metric in metrics]
    mean = filled[0]
    for metric in filled[1:]:
        mean = mean + metric
    mean = mean / len(filled)
    return F.when(mean < 5, "low").when(mean < 15, "medium").otherwise("high")


def cleaning_summary(result: DataFrame) -> DataFrame:
    """VIEW6, SRT1: metrics improved by more than 0.1, largest gain first.

    ``result`` has structs ``before`` and ``after`` with the metrics."""

    def side(name: str, metric: str) -> Column:
        return F.coalesce(F.col(f"{name}.{metric}").cast("double"), F.lit(0.0))

    entries = [
        F.struct(
            F.lit(place).alias("place"),
            F.lit(metric).alias("metric"),
            F.lit(label).alias("label"),
            side("before", metric).alias("before"),
            side("after", metric).alias("after"),
            one_decimal(side("before", metric) - side("after", metric)).alias("fixed"),
        )
        for place, (metric, label) in enumerate(IMPROVABLE.items())
    ]
    return (
        result.select(F.inline(F.array(*entries)))
        .where(F.col("fixed") > 0.1)
        .orderBy(F.desc("fixed"), "place")
        .drop("place")
    )


def clipped_cells(report: str = "cleaning_report") -> Column:
    """AGG13: cells moved by clipping, from the entries of a cleaning report."""
    return F.aggregate(
        f"{report}.outlier_clipping",
        F.lit(0).cast("long"),
        lambda acc, entry: acc
        + F.coalesce(entry["clipped_low"], F.lit(0))
        + F.coalesce(entry["clipped_high"], F.lit(0)),
    )


def _sentence(prefix: str, count: Column) -> Column:
    return F.when(count > 0, F.concat(F.lit(prefix), grouped_digits(count)))


def cleaning_actions(result: DataFrame) -> DataFrame:
    """VIEW7: adds ``actions``; without an action in the report, count changes tell."""
    report = F.col("cleaning_report")

    def gone(metric: str) -> Column:
        def side(name: str) -> Column:
            return F.coalesce(F.col(f"{name}.{metric}"), F.lit(0))

        return F.greatest(side("before") - side("after"), F.lit(0))

    reported = F.array_compact(
        F.array(
            _sentence("Missing values fixed: ", report.missing_before - report.missing_after),
            _sentence("Duplicate rows removed: ", report.duplicates_removed),
            _sentence("Outlier values clipped to IQR bounds: ", clipped_cells()),
        )
    )
    derived = F.array_compact(
        F.array(
            _sentence("Missing values fixed: ", gone("missing_count")),
            _sentence("Duplicate rows removed: ", gone("duplicate_count")),
            _sentence("Outliers handled: ", gone("outlier_count")),
        )
    )
    nothing = F.array(F.lit("Standard cleaning pipeline executed."))
    actions = (
        F.when(F.size(F.coalesce(reported, F.array().cast("array<string>"))) > 0, reported)
        .when(F.size(derived) > 0, derived)
        .otherwise(nothing)
    )
    return result.withColumn("actions", actions)


def rows_removed() -> Column:
    """VIEW8 over a result row."""
    return F.coalesce(
        F.col("cleaning_report.duplicates_removed"),
        F.greatest(
            F.coalesce(F.col("before.total_rows"), F.lit(0))
            - F.coalesce(F.col("after.total_rows"), F.lit(0)),
            F.lit(0),
        ),
    )


def imputation_preview(entries: int = 8) -> Column:
    """TOP2: the first imputations of a cleaning report."""
    return F.slice("cleaning_report.imputations", 1, entries)


def run_improvement(history: DataFrame, threshold: float = 95.0) -> DataFrame:
    """VIEW9: score change of each run, and whether it ended above the threshold."""
    before = F.coalesce(F.col("before_trust_score"), F.lit(0.0))
    after = F.coalesce(F.col("after_trust_score"), F.lit(0.0))
    return history.select(
        "*",
        one_decimal(after - before).alias("improvement"),
        (after >= threshold).alias("above_threshold"),
    )
