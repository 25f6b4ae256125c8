import pytest
from pyspark.sql import functions as F

from plumbline import predict_trust_score
from plumbline.operators.forest import load_forest, training_table
from plumbline.operators.profile import QUALITY_FEATURES
from plumbline.operators.trust import confidence_level

SCHEMA = ", ".join(f"{name} double" for name in QUALITY_FEATURES)
PERFECT = (0.0,) * 7
POOR = (40.0, 20.0, 10.0, 20.0, 80.0, 10.0, 3.0)
WORST = (100.0, 100.0, 100.0, 100.0, 100.0, 100.0, 100.0)


def _scores(frame, scorer, *rows):
    return [row for row in predict_trust_score(frame(SCHEMA, *rows), scorer).collect()]


def test_formula(frame):
    perfect, poor, worst = _scores(frame, "formula", PERFECT, POOR, WORST)
    assert perfect.trust_score == 100.0
    lost = 40 * 0.3 + 20 * 0.25 + 10 * 0.15 + 20 * 0.12 + 80 * 0.08 + 10 * 0.05 + 3 * 0.5
    assert poor.trust_score == round(100 - lost, 2)
    # The skewness penalty is capped, the other weights sum to 0.95.
    assert worst.trust_score == 0.0


def test_skewness_penalty_is_capped(frame):
    (row,) = _scores(frame, "formula", (0.0,) * 6 + (500.0,))
    assert row.trust_score == 90.0


def test_confidence_limits(frame):
    rows = frame("s double", 3.49, 3.5, 6.99, 7.0).select(confidence_level(F.col("s"))).collect()
    assert [row[0] for row in rows] == ["High", "Medium", "Medium", "Low"]


def test_forest_range_order_and_spread(frame):
    by_score = {row.missing_pct: row for row in _scores(frame, "forest", PERFECT, POOR, WORST)}
    perfect, poor, worst = by_score[0.0], by_score[40.0], by_score[100.0]
    assert 100 >= perfect.trust_score > poor.trust_score > worst.trust_score >= 0
    assert perfect.trust_score < 95.0
    assert all(row.std_dev >= 0 for row in by_score.values())
    assert abs(sum(perfect.importances.values()) - 100.0) < 0.1
    assert max(perfect.importances, key=perfect.importances.get) == "Missing Values"


def test_leaf_lookup_is_the_forest_prediction(spark, frame):
    df = frame(SCHEMA, PERFECT, POOR, WORST)
    own = {row.missing_pct: row.trust_score for row in predict_trust_score(df, "forest").collect()}
    model = load_forest(spark).model
    for row in model.transform(df).collect():
        assert own[row.missing_pct] == pytest.approx(row["__prediction"], abs=0.0051)


def test_training_table_is_stable(spark):
    first, second = training_table(spark), training_table(spark)
    assert first.collect() == second.collect()
    assert first.count() == 1500
    low, high = first.agg(F.min("trust_score"), F.max("trust_score")).first()
    assert 0 <= low < high <= 100


def test_unknown_scorer(frame):
    with pytest.raises(ValueError):
        predict_trust_score(frame(SCHEMA, PERFECT), "guess")
