import pytest
from pyspark.sql import functions as F

from checks.tables import dirty, gaps
from conftest import SMALLEST
from plumbline import analyze_quality, clean_data
from plumbline.operators.value_counts import modes


def _clean(df, limits, key=None):
    result = clean_data(df, key, limits)
    return result, result.report().first()


def _fill(df, limits):
    result, report = _clean(df, limits)
    return report.imputations[0] if report.imputations else None


def test_dirty_report(spark, limits):
    result, report = _clean(dirty(spark, SMALLEST), limits, "row_id")
    assert report.duplicates_removed == 75
    assert (report.missing_before, report.missing_after) == (3843, 0)
    assert [tuple(entry) for entry in report.imputations] == [
        ("amount", "median_skewed_numeric", 215, "258770.68"),
        ("price", "mean_near_symmetric_numeric", 167, "251222.19054"),
        ("priority", "mode_categorical", 198, "3-MEDIUM"),
        ("tag", "placeholder_high_cardinality", 79, "Unknown"),
        ("empty_num", "constant_0_all_missing", 1500, "0.0"),
        ("empty_txt", "placeholder_all_missing", 1500, "Unknown"),
    ]
    assert [tuple(entry) for entry in report.outlier_clipping] == [
        ("amount", -166001.75125, 668937.47875, 0, 11)
    ]
    assert tuple(report.validation) == (True, True)
    after = analyze_quality(result.frame, "row_id", limits).first()
    # The placeholder is itself a missing marker.
    assert after.missing_count == 79 + 1500
    assert after.outlier_count == 0
    again, second = _clean(result.frame, limits, "row_id")
    assert second.duplicates_removed == 0


def test_mode_ties_give_the_smallest(frame, limits):
    df = frame("i int, v string", (1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None))
    assert tuple(_fill(df, limits)) == ("v", "mode_categorical", 1, "a")


@pytest.mark.parametrize("distinct, strategy", [(19, "mode_categorical"), (20, "placeholder_high_cardinality")])
def test_cardinality_limits(frame, limits, distinct, strategy):
    df = frame("i int, v string", *[(i, f"t{i:02d}") for i in range(distinct)], (99, None))
    assert _fill(df, limits).strategy == strategy


def test_cardinality_ratio_is_strict(frame, limits):
    # 18 distinct of 20 values is exactly 0.9.
    values = [f"t{i:02d}" for i in range(18)] + ["t00", "t01"]
    df = frame("i int, v string", *enumerate(values), (99, None))
    assert tuple(_fill(df, limits)) == ("v", "mode_categorical", 1, "t00")


def test_skew_limit(frame, limits):
    symmetric = frame("i int, v double", *enumerate([1.0, 2.0, 3.0, 4.0]), (99, None))
    assert tuple(_fill(symmetric, limits)) == ("v", "mean_near_symmetric_numeric", 1, "2.5")
    skewed = frame("i int, v double", *enumerate([1.0, 2.0, 3.0, 100.0]), (99, None))
    assert tuple(_fill(skewed, limits)) == ("v", "median_skewed_numeric", 1, "2.5")
    two = frame("i int, v double", (1, 1.0), (2, 100.0), (3, None))
    assert _fill(two, limits).strategy == "mean_near_symmetric_numeric"


def test_whole_numbers_become_doubles_when_filled(frame, limits):
    result, _ = _clean(frame("i int, v int", (1, 1), (2, 2), (3, None)), limits)
    assert dict(result.frame.dtypes) == {"i": "int", "v": "double"}
    assert sorted(row.v for row in result.frame.collect()) == [1.0, 1.5, 2.0]


def test_booleans_and_times(spark, limits):
    df = spark.sql(
        "SELECT * FROM VALUES (1, true, TIMESTAMP'2024-01-01', CAST(NULL AS DATE)), "
        "(2, true, TIMESTAMP'2024-01-01', NULL), (3, NULL, NULL, NULL), "
        "(4, false, TIMESTAMP'2023-01-01', NULL) AS t(i, b, t, d)"
    )
    result, report = _clean(df, limits)
    assert [tuple(entry)[:3] for entry in report.imputations] == [
        ("b", "mode_categorical", 1),
        ("t", "mode_categorical", 1),
        ("d", "placeholder_all_missing", 4),
    ]
    assert dict(result.frame.dtypes) == {"i": "int", "b": "boolean", "t": "timestamp", "d": "string"}
    assert report.validation.no_missing_values


def test_filling_may_create_duplicates(spark, frame, limits):
    df = frame("a int, b string", (1, None), (1, "a"), (2, "a"))
    result, report = _clean(df, limits)
    assert report.duplicates_removed == 0
    assert not report.validation.no_duplicate_rows
    assert result.frame.count() == 3
    _, report = _clean(gaps(spark, SMALLEST), limits, "row_id")
    assert not report.validation.no_duplicate_rows


def test_clipping_keeps_rows_and_order_of_bounds(frame, limits):
    values = [float(i) for i in range(20)] + [1000.0, -1000.0]
    df = frame("i int, v double", *enumerate(values))
    result, report = _clean(df, limits)
    entry = report.outlier_clipping[0]
    assert (entry.column, entry.clipped_low, entry.clipped_high) == ("v", 1, 1)
    low, high = result.frame.agg(F.min("v"), F.max("v")).first()
    assert (round(low, 6), round(high, 6)) == (entry.lower_bound, entry.upper_bound)
    assert result.frame.count() == 22


def test_fences_come_from_filled_data(frame, limits):
    # Ten gaps filled with the mean leave no spread between the quartiles.
    values = [0.0, 1.0, 2.0, 3.0, 4.0] + [None] * 20
    df = frame("i int, v double", *enumerate(values))
    _, report = _clean(df, limits)
    assert report.outlier_clipping == []


def test_modes_of_several_columns(frame):
    df = frame("a string, b string", ("x", "q"), ("x", "p"), ("y", "p"), (None, "q"))
    found = {row["column"]: tuple(row)[1:] for row in modes(df, ["a", "b"]).collect()}
    assert found == {"a": (3, 2, "x", 2), "b": (4, 2, "p", 2)}


def test_infinite_values_survive(frame, limits):
    inf = float("inf")
    df = frame("k int, v double", *[(i, inf) for i in range(8)], (8, 1.0), (9, 2.0))
    result, report = _clean(df, limits)
    assert sorted(row.v for row in result.frame.collect()) == [1.0, 2.0] + [inf] * 8
    assert report.outlier_clipping == []
    row = analyze_quality(df, limits=limits).first()
    assert row.outlier_count == 0


def test_no_mean_of_both_infinities(frame, limits):
    inf = float("inf")
    filled = _fill(frame("k int, v double", (1, inf), (2, -inf), (3, 1.0), (4, 2.0), (5, None)), limits)
    assert filled.fill_value in ("0.0", "0", "1.5")


def test_modes_equal_counting_texts(frame, monkeypatch):
    from collections import Counter
    import random

    from plumbline.functions import bitmap

    turn = random.Random(5)
    texts = [None, "", "a", "ab", "common prefix 1", "common prefix 2", "common prefix 10", "ü", "漢字", "zz"]
    rows = [
        (turn.choice(texts), f"common prefix {turn.randrange(40)}", f"unique {i:05d}", None if i % 3 else turn.choice("xy"), i % 2 == 0)
        for i in range(400)
    ]
    names = ["a", "b", "c", "d", "e"]
    df = frame("a string, b string, c string, d string, e boolean", *rows)

    def wanted(place):
        counted = Counter(str(r[place]).lower() if place == 4 else r[place] for r in rows if r[place] is not None)
        most = max(counted.values())
        mode = min((v for v, n in counted.items() if n == most), key=lambda v: v.encode())
        return names[place], sum(counted.values()), len(counted), mode, most

    expected = sorted(wanted(i) for i in range(5))
    assert sorted(map(tuple, modes(df, names).collect())) == expected
    # A crowded bitmap lets texts pass that are no candidates; the counts tell.
    monkeypatch.setattr(bitmap, "BITS", 2)
    assert sorted(map(tuple, modes(df, names).collect())) == expected


def test_modes_shuffle_no_text(frame):
    from plumbline.operators.value_counts import count_values

    counts = count_values(frame("t string", *["x" * 100 + str(i % 7) for i in range(50)]), ["t"])
    assert counts.counted.columns == ["part", "slot", "prefix", "h1", "h2", "cells"]
    assert max(len(r.prefix) for r in counts.counted.collect()) == 8
