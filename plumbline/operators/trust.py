"""Trust score by the penalty formula, and the entry point over both scorers (TRU2, TRU8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rounding import round_exact
from plumbline.operators.profile import QUALITY_FEATURES

# Points lost per unit of each metric.
PENALTIES = {
    "missing_pct": 0.30,
    "duplicate_pct": 0.25,
    "outlier_pct": 0.15,
    "type_inconsistency_pct": 0.12,
    "null_col_ratio": 0.08,
    "constant_col_ratio": 0.05,
    "avg_skewness": 0.50,
}
SKEWNESS_PENALTY_CAP = 10.0

# Names of the metrics in importance maps.
FEATURE_LABELS = {
    "missing_pct": "Missing Values",
    "duplicate_pct": "Duplicate Rows",
    "outlier_pct": "IQR Outliers",
    "type_inconsistency_pct": "Type Inconsistency",
    "null_col_ratio": "Null Column Ratio",
    "constant_col_ratio": "Constant Columns",
    "avg_skewness": "Data Skewness",
}

# Spread between trees below which a score is trusted.
CONFIDENCE_LEVELS = ((3.5, "High"), (7.0, "Medium"))
LOWEST_CONFIDENCE = "Low"


def clip_score(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def penalty_score(noise: Column | None = None) -> Column:
    """The formula over the seven metric columns, unrounded."""
    score = F.lit(100.0)
    for name in QUALITY_FEATURES:
        lost = F.col(name).cast("double") * PENALTIES[name]
        if name == "avg_skewness":
            lost = F.least(lost, F.lit(SKEWNESS_PENALTY_CAP))
        score = score - lost
    return clip_score(score if noise is None else score + noise)


def confidence_level(std_dev: Column) -> Column:
    """TRU6."""
    level = F.lit(LOWEST_CONFIDENCE)
    for bound, name in reversed(CONFIDENCE_LEVELS):
        level = F.when(std_dev < bound, name).otherwise(level)
    return level


def predict_trust_score(metrics: DataFrame, scorer: str = "forest") -> DataFrame:
    """Adds ``trust_score, std_dev, confidence_level, importances`` to metrics rows."""
    if scorer == "forest":
        from plumbline.operators.forest import forest_score

        return forest_score(metrics)
    if scorer != "formula":
        raise ValueError(f"unknown scorer: {scorer}")
    weight = sum(PENALTIES.values())
    importances = F.create_map(
        *[
            item
            for name in QUALITY_FEATURES
            for item in (
                F.lit(FEATURE_LABELS[name]),
                F.lit(round(PENALTIES[name] / weight * 100.0, 2)),
            )
        ]
    )
    return metrics.select(
        "*",
        round_exact(penalty_score(), 2).alias("trust_score"),
        F.lit(0.0).alias("std_dev"),
        confidence_level(F.lit(0.0)).alias("confidence_level"),
        importances.alias("importances"),
    )
