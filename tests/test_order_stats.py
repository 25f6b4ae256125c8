import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import DISTRIBUTED
from plumbline.operators.order_stats import order_statistics, quantiles

SHARES = (0.25, 0.5, 0.75)


def _quantiles(spark, columns, limits):
    size = len(next(iter(columns.values())))
    rows = [tuple(values[i] for values in columns.values()) for i in range(size)]
    df = spark.createDataFrame(rows, ", ".join(f"{name} double" for name in columns)).repartition(3)
    counts = {name: sum(v is not None for v in values) for name, values in columns.items()}
    return quantiles(df, {name: F.col(name) for name in columns}, counts, SHARES, limits)


def test_same_as_numpy_on_hard_columns(spark, limits):
    rng = random.Random(3)
    size = 500
    columns = {
        "even": [rng.uniform(0, 1) for _ in range(size)],
        "hot": [7.0 if rng.random() < 0.4 else rng.uniform(-1, 1) for _ in range(size)],
        "constant": [3.5] * size,
        "heavy": [rng.lognormvariate(0, 40) for _ in range(size)],
        "signs": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(size)],
        "gaps": [None if i % 3 else float(i) for i in range(size)],
        "two": [float(i % 2) for i in range(size)],
        "empty": [None] * size,
    }
    found = _quantiles(spark, columns, limits)
    assert "empty" not in found
    for name, values in columns.items():
        known = [v for v in values if v is not None]
        if known:
            expected = np.quantile(np.array(known), SHARES)
            np.testing.assert_allclose(found[name], expected, rtol=1e-12, err_msg=name)


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [2.0, 1.0, 4.0]])
def test_few_values(spark, limits, values):
    found = _quantiles(spark, {"v": values}, limits)
    np.testing.assert_allclose(found["v"], np.quantile(values, SHARES))


def test_infinite_values(spark):
    values = [float("-inf")] * 2 + [1.0, 2.0, 3.0] + [float("inf")] * 2
    found = _quantiles(spark, {"v": values}, DISTRIBUTED)
    assert found["v"][1] == 2.0
    mostly = _quantiles(spark, {"v": [float("inf")] * 8 + [1.0, 2.0]}, DISTRIBUTED)
    assert mostly["v"][-1] == float("inf")


def test_sparse_column_beyond_the_sample(spark):
    # Five values in 300,000 rows: the sketched sample holds none or few of them.
    df = spark.range(300_000).select(
        F.when(F.col("id") % 60_000 == 7, F.col("id").cast("double")).alias("few"),
        F.col("id").cast("double").alias("all"),
    )
    columns = {"few": F.col("few"), "all": F.col("all")}
    found = quantiles(df, columns, {"few": 5, "all": 300_000}, SHARES, DISTRIBUTED)
    assert found["few"] == (60_007.0, 120_007.0, 180_007.0)
    assert found["all"] == tuple(np.quantile(np.arange(300_000), SHARES))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e9, 1e9, width=32), min_size=1, max_size=60), st.data())
def test_any_rank(spark, values, data):
    rank = data.draw(st.integers(0, len(values) - 1))
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = order_statistics(df, {"v": F.col("v")}, {"v": {rank}}, {"v": len(values)}, limits=DISTRIBUTED)
    assert found["v", rank][0] == sorted(values)[rank]
