import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.tables import dirty
from conftest import SMALLEST
from plumbline import analyze_quality
from plumbline.operators.distinct import count_distinct_rows, distinct_rows
from plumbline.operators.normalize import normalize_missing
from plumbline.operators.profile import column_statistics, constant_columns, mixed_type_columns


def _metrics(df, limits, **options):
    return analyze_quality(df, limits=limits, **options).first()


def test_dirty_table(spark, limits):
    row = _metrics(dirty(spark, SMALLEST), limits, key="row_id")
    assert row.asDict() == {
        "total_rows": 1575, "missing_count": 3843, "missing_pct": 24.4, "duplicate_count": 75,
        "duplicate_pct": 4.76, "outlier_count": 11, "outlier_pct": 0.25,
        "type_inconsistency_pct": 10.0, "null_col_ratio": 60.0, "constant_col_ratio": 30.0,
        "avg_skewness": 5.108,
    }


def test_nan_counts_as_missing(frame, limits):
    row = _metrics(frame("v double", float("nan"), None, 1.0), limits)
    assert row.missing_count == 2


def test_fences_need_four_values_and_a_spread(frame, limits):
    few = _metrics(frame("v double", 1.0, 2.0, 1e9), limits)
    assert (few.outlier_count, few.outlier_pct, few.avg_skewness) == (0, 0.0, 0.0)
    flat = _metrics(frame("v double", 1.0, 1.0, 1.0, 1.0, 100.0), limits)
    assert (flat.outlier_count, flat.avg_skewness) == (0, 0.0)


def test_value_on_the_fence_is_inside(frame, limits):
    # Quartiles 1 and 3, fences -2 and 6.
    values = [1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 3.0, 3.0]
    series = pd.Series(values + [6.0])
    upper = series.quantile(0.75) + 1.5 * (series.quantile(0.75) - series.quantile(0.25))
    assert upper == 6.0
    assert _metrics(frame("v double", *values, 6.0), limits).outlier_count == 0
    assert _metrics(frame("v double", *values, 6.5), limits).outlier_count == 1


def test_skewness_is_the_corrected_one(frame, limits):
    values = [1.0, 2.0, 2.5, 3.0, 9.0, 4.0]
    row = _metrics(frame("v double", *values), limits)
    assert row.avg_skewness == round(abs(pd.Series(values).skew()), 3)


def test_mixed_types_limits(frame):
    def mixed(numbers, words):
        df = frame("v string", *(["1"] * numbers + ["x"] * words))
        return mixed_type_columns(df).first().is_mixed

    assert not mixed(1, 9)
    assert not mixed(9, 1)
    assert mixed(2, 8)
    assert not mixed(2, 2)
    assert mixed(2, 3)


def test_text_column_of_numbers_stays_text(frame, limits):
    row = _metrics(frame("v string", "1", "2", "3", "-", "1000"), limits)
    assert (row.missing_count, row.outlier_count, row.type_inconsistency_pct) == (1, 0, 0.0)


def test_constant_columns(frame):
    df = frame("a string, b string, c string, d int", ("x", "x", None, 1), ("x", None, None, 1))
    assert constant_columns(df, column_statistics(df).collect()) == {"a", "c", "d"}


def test_duplicates_after_markers(frame, limits):
    df = frame("a string, b int", ("NA", 1), (None, 1), (" null", 1), ("x", 2))
    row = _metrics(df, limits)
    assert (row.duplicate_count, row.duplicate_pct) == (2, 50.0)


def test_booleans_are_not_numbers(frame, limits):
    row = _metrics(frame("v boolean", True, True, True, True, False, None), limits)
    assert (row.outlier_count, row.missing_count) == (0, 1)


def test_empty_table_is_an_error(frame):
    with pytest.raises(ValueError):
        analyze_quality(frame("v int"))


def test_odd_column_names_and_nested_types(spark, limits):
    df = spark.sql(
        "SELECT 1 AS `a.b`, array(1, 2) AS `l i`, map('k', 1) AS m, CAST(NULL AS STRING) AS `q``q` "
        "UNION ALL SELECT 2, array(1, 2), map('k', 1), 'z'"
    )
    row = _metrics(df, limits)
    assert (row.total_rows, row.missing_count, row.duplicate_count) == (2, 1, 0)
    assert row.constant_col_ratio == 25.0


def test_distinct_rows(spark, frame, limits):
    rows = [(i % 7, None if i % 3 else "x", float(i % 2)) for i in range(60)]
    df = frame("a int, b string, c double", *rows)
    assert count_distinct_rows(df, 60, limits=limits).first()[0] == len(set(rows))
    kept = distinct_rows(df, 60, limits=limits)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, set(rows)))
    keyed = df.withColumn("id", F.monotonically_increasing_id()).cache()
    first = keyed.groupBy("a", "b", "c").agg(F.min("id").alias("id")).select("id")
    chosen = distinct_rows(keyed, 60, "id", limits).select("id")
    assert sorted(chosen.collect()) == sorted(first.collect())


def test_most_rows_equal(spark, limits):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("v"))
    assert count_distinct_rows(df, 3000, limits=limits).first()[0] == 2001


def test_crowded_bitmap_changes_nothing(frame, monkeypatch):
    from plumbline.functions import bitmap

    # Eight places: nearly all rows pass and are compared in full.
    monkeypatch.setattr(bitmap, "BITS", 3)
    df = frame("v int, t string", *[(i % 5, "x") for i in range(20)], *[(100 + i, "y") for i in range(50)])
    assert count_distinct_rows(df, 70).first()[0] == 55
    assert distinct_rows(df, 70).count() == 55


def test_bitmap_holds_what_was_put_in(spark):
    from plumbline.functions.bitmap import bitmap_of, mark_members

    digests = spark.range(5000).select(F.xxhash64("id").alias("h"))
    words = bitmap_of(digests, "h")
    assert words.count() <= 1 << 18
    everything = spark.range(100_000).select("id", F.xxhash64("id").alias("h"))
    marked = mark_members(everything, "h", words, "there")
    assert marked.where("there AND id < 5000").count() == 5000
    assert marked.where("there AND id >= 5000").count() < 100


def test_normalization_keeps_types(frame):
    df = frame("a string, b int, c float", ("none", 1, float("nan")))
    out = normalize_missing(df)
    assert [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
    assert tuple(out.first()) == (None, 1, None)
