from pyspark.sql import functions as F

from checks.tables import dirty
from conftest import SMALLEST
from plumbline import evaluate_cleaning_accuracy
from plumbline.operators.evaluate import (
    clamp_fraction,
    duplicate_fix_accuracy,
    fit_masking,
    imputation_accuracy,
    masked_cells,
    outlier_fix_effectiveness,
)
from plumbline.operators.sampling import Cut, cell_hash, fit_cuts, with_row_hash


def test_exact_sample_sizes(spark, limits):
    df = dirty(spark, SMALLEST)
    masking = fit_masking(df, "row_id", 0.1, 42, limits)
    counted = masked_cells(df, masking).groupBy("column").count().collect()
    assert {row["column"]: row["count"] for row in counted} == masking.sizes
    assert masking.sizes["o_orderkey"] == 157
    other = fit_masking(df, "row_id", 0.1, 43, limits)
    assert other.cuts != masking.cuts


def test_tied_hashes_go_by_key(spark, monkeypatch, limits):
    import plumbline.operators.sampling as sampling

    monkeypatch.setattr(sampling, "cell_hash", lambda label, seed: F.lit(5.0))
    df = spark.range(20).withColumnRenamed("id", "k")
    cuts = fit_cuts(df, "k", {"x": F.lit(True)}, {"x": 20}, {"x": 7}, 1, limits)
    assert cuts["x"] == Cut(5.0, 6)
    kept = with_row_hash(df, "k", 1).where(cuts["x"].chosen("k", "x", 1))
    assert sorted(row.k for row in kept.collect()) == list(range(7))


def test_hash_is_spread_and_stable(spark):
    hashed = with_row_hash(spark.range(4000), "id", 1)
    df = hashed.select(cell_hash("c", 1).alias("c"), cell_hash("d", 1).alias("d"))
    low, high, number = df.agg(F.min("c"), F.max("c"), F.countDistinct("c")).first()
    assert 0 <= low < high < 16**13 and number == 4000
    # Evenly spread, and one column's order says nothing about another's.
    half = F.lit(16**13 / 2)
    left, both = df.agg(
        F.avg((F.col("c") < half).cast("int")),
        F.avg(((F.col("c") < half) & (F.col("d") < half)).cast("int")),
    ).first()
    assert abs(left - 0.5) < 0.04 and abs(both - 0.25) < 0.04
    assert abs(df.agg(F.corr("c", "d")).first()[0]) < 0.08


def test_perfect_and_hopeless_imputation(frame, limits):
    rows = [(i, "same", float(i % 2)) for i in range(50)]
    found = imputation_accuracy(frame("k int, t string, n double", *rows), "k", 0.1, 1, limits).first()
    # Rows are duplicates but for the key, so most masked cells vanish with their row.
    assert found.masked_cells == 10
    # Two identifying columns, so that blanking one leaves the rows distinct.
    unique = [(i, i, i, "same", float(1000 ** (i % 5))) for i in range(50)]
    found = imputation_accuracy(
        frame("k int, id int, id2 int, t string, n double", *unique), "k", 0.1, 1, limits
    ).first()
    assert found.categorical_exact_match_accuracy == 100.0
    assert found.numeric_within_5pct_accuracy <= 50.0


def test_duplicate_fix(frame, limits):
    df = frame("k int, v int", *[(i, i) for i in range(30)], *[(100 + i, i) for i in range(10)])
    found = duplicate_fix_accuracy(df, "k", 0.1, 42, limits).first()
    assert tuple(found) == (3, 3, 100.0)


def test_duplicate_fix_of_nothing(frame):
    assert tuple(duplicate_fix_accuracy(frame("k int, v int"), "k").first()) == (0, 0, 100.0)


def test_no_outliers_means_no_reduction(frame, limits):
    df = frame("k int, v double", *[(i, float(i)) for i in range(20)])
    assert tuple(outlier_fix_effectiveness(df, "k", limits).first()) == (0, 0, 0.0)


def test_fractions_are_clamped():
    assert [clamp_fraction(f) for f in (0.0, 0.01, 0.3, 0.5, 0.9)] == [0.01, 0.01, 0.3, 0.5, 0.5]


def test_score_without_a_key(frame):
    df = frame("id int, v double, t string", *[(i, float(i), "a") for i in range(40)])
    row = evaluate_cleaning_accuracy(df, mask_fraction=0.0, duplicate_fraction=2.0).first()
    assert row.evaluation.mask_fraction == 0.01
    assert row.evaluation.duplicate_fraction == 0.5
    parts = row.imputation_accuracy, row.duplicate_fix, row.outlier_fix
    expected = round(
        0.6 * parts[0].overall_imputation_accuracy
        + 0.25 * parts[1].duplicate_fix_accuracy
        + 0.15 * parts[2].outlier_reduction_pct,
        2,
    )
    assert row.evaluation.overall_cleaning_accuracy_score == expected
    assert parts[1].injected_duplicates == 20
