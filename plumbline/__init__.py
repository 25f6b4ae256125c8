"""Plumbline: measure, score and repair the quality of tables with Spark."""

from plumbline.limits import DEFAULT_LIMITS, Limits
from plumbline.operators.clean import clean_data
from plumbline.operators.evaluate import evaluate_cleaning_accuracy
from plumbline.operators.profile import analyze_quality
from plumbline.operators.trust import predict_trust_score
from plumbline.plans.quality_run import run_quality

__all__ = [
    "DEFAULT_LIMITS",
    "Limits",
    "analyze_quality",
    "clean_data",
    "evaluate_cleaning_accuracy",
    "predict_trust_score",
    "run_quality",
]
