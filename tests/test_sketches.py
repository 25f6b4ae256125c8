import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.sketches import approximate_fences, column_sketches, rank_error, sketched_quantiles

SCHEMA = "k long, a double, b int, s string"


def test_ranks_within_the_stated_error(frame):
    rng = random.Random(7)
    values = [rng.lognormvariate(0, 3) for _ in range(20_000)] + [1.5] * 10_000
    df = frame("part int, v double", *[(i % 7, v) for i, v in enumerate(values)])
    stored = column_sketches(df, F.col("part"), size=200).where("column = 'v'")
    assert stored.count() == 7
    ordered, error = sorted(values), rank_error(200)
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    found = sketched_quantiles(stored, shares).first()
    assert found["non_null"] == len(values)
    for share, value in zip(shares, found["values"]):
        below = sum(v < value for v in ordered) / len(ordered)
        reached = sum(v <= value for v in ordered) / len(ordered)
        assert below <= share + error and reached >= share - error


def test_appended_parts_change_the_quartiles(frame, tmp_path):
    path = str(tmp_path / "sketches")
    first = frame("v int", *range(100))
    column_sketches(first, F.lit("first")).write.parquet(path)
    spark = first.sparkSession
    (fence,) = approximate_fences(spark.read.parquet(path))
    assert (fence.non_null, fence.q1, fence.q3) == (100, 24.0, 74.0)
    column_sketches(frame("v int", *range(100, 300)), F.lit("second")).write.mode("append").parquet(path)
    (fence,) = approximate_fences(spark.read.parquet(path))
    assert (fence.non_null, fence.q1, fence.q3) == (300, 74.0, 224.0)


def test_nulls_infinities_and_few_values(frame):
    df = frame(
        SCHEMA,
        (1, 1.0, None, "x"),
        (2, math.nan, None, None),
        (3, math.inf, None, "y"),
        (4, math.inf, 2, "x"),
        (5, -math.inf, 2, ""),
        (6, None, 2, "x"),
    )
    sketches = column_sketches(df, key="k")
    rows = {row["column"]: row for row in sketched_quantiles(sketches, (0.0, 1.0)).collect()}
    assert {name: row["non_null"] for name, row in rows.items()} == {"a": 4, "b": 3}
    (fence,) = approximate_fences(sketches)
    assert fence.column == "a" and (fence.q1, fence.q3) == (-math.inf, math.inf)
    nothing = frame("a double", (None,), (None,))
    assert sketched_quantiles(column_sketches(nothing), (0.5,)).first()["values"] is None
    assert approximate_fences(column_sketches(nothing)) == []


def test_empty_tables_and_names_that_clash(frame):
    assert column_sketches(frame("a double")).count() == 0
    assert column_sketches(frame("s string", "x")).count() == 0
    df = frame("part int, tasks int, `column` int, v0 int", *[(i, i, i, i) for i in range(10)])
    found = approximate_fences(column_sketches(df, F.col("part") % 2))
    assert {f.column: (f.non_null, f.q1) for f in found} == dict.fromkeys(("part", "tasks", "column", "v0"), (10, 2.0))


def test_smaller_sketches_err_more():
    assert rank_error(200) > rank_error(2000) > 0
    assert rank_error() == pytest.approx(0.0014, abs=1e-4)
