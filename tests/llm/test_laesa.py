import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from helpers import from_files

pytest.importorskip("plumbline.llm")
from plumbline.llm import laesa  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute(rows, number=16, rounds=3, components=64, scale=64):
    """Plain Python integers; every vector against every centroid."""
    kept = [
        (i, [math.floor(scale * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)
    ]
    hashed = sorted(
        (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept
    )
    centroids = [v for _, _, v in hashed[:number]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        centroids = [
            [sum(column) // len(members[k]) for column in zip(*members[k])] if k in members else c
            for k, c in enumerate(centroids)
        ]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], centroids


def key(row):
    return tuple((x is None, x or 0) for x in row)


def same(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found, centroids, _ = laesa.cluster_vectors(df, **options)
    wanted, wanted_centroids = brute(df.collect(), **{"number" if k == "centroids" else k: v for k, v in options.items()})
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(wanted, key=key)
    assert centroids.tolist() == wanted_centroids


def test_bounds_never_change_the_nearest_centroid():
    turn = np.random.default_rng(3)
    for spread in (2, 40, 5000, 1 << 26):
        points = turn.integers(-spread, spread + 1, (500, 8))
        centroids = points[turn.integers(0, 500, 12)]
        pivots = laesa.choose_pivots(centroids, 4)
        far = np.stack([laesa.squared(points, p) for p in pivots], axis=1)
        cluster, best, measured = laesa.assign(points, far, centroids, pivots)
        every = np.stack([laesa.squared(points, c) for c in centroids], axis=1)
        assert (cluster == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
        assert 500 <= measured <= 500 * 12


def test_bounds_save_work():
    turn = np.random.default_rng(4)
    centres = turn.integers(-3000, 3000, (16, 64))
    points = centres[turn.integers(0, 16, 2000)] + turn.integers(-40, 41, (2000, 64))
    pivots = laesa.choose_pivots(centres, 8)
    far = np.stack([laesa.squared(points, p) for p in pivots], axis=1)
    *_, measured = laesa.assign(points, far, centres, pivots)
    assert measured < 2000 * 3


def test_pivots_are_different_points():
    twice = np.array([[0, 0], [0, 0], [3, 4], [3, 4]])
    assert laesa.choose_pivots(twice, 4).tolist() == [[0, 0], [3, 4]]
    assert len(laesa.choose_pivots(np.empty((0, 2), np.int64), 4)) == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_vectors_with_ties_and_copies(spark, seed):
    turn = random.Random(seed)
    # A coarse grid makes ties; every third vector is the same.
    rows = [(i // 2, [turn.randrange(-2, 3) / 64 for _ in range(4)]) for i in range(150)]
    rows += [(1000 + i, [0.0, 0.0, 1 / 64, 0.0]) for i in range(75)]
    same(spark, rows, components=4, centroids=6)


def test_messy_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, [1.0, 2.0, 3.0]),
        (8, [-0.001, 0.5]), (8, [0.25, 0.5]), (8, [0.25, 0.5]), (None, [0.1, 0.1]), (9, [-1.0, -1.0]),
    ]
    same(spark, rows, components=2, centroids=3)
    # Fewer vectors than centroids, and none.
    same(spark, rows, components=2)
    same(spark, rows[:5], components=2)
    same(spark, [], components=2)


def test_extra_columns_are_ignored(spark):
    rows = [(i, 1, 2, "x", [i / 64, -i / 64]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id int, cluster int, point int, far string, embedding array<double>")
    found, _, shares = laesa.cluster_vectors(df, components=2, centroids=2)
    wanted, _ = brute([(r.vec_id, r.embedding) for r in df.collect()], number=2, components=2)
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert len(shares) == 3 and all(0 < s <= 1 for s in shares)


def test_components_too_large_for_exact_distances(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="exact distances"):
        laesa.cluster_vectors(df, components=2)


def test_query_equals_brute_force_and_sql(spark):
    rows = sorted(map(tuple, laesa.op12_laesa_clustering(spark, SF).collect()))
    wanted, centroids = brute([(r.vec_id, r.embedding) for r in from_files(spark, "embeddings").collect()])
    inertia = {}
    for _, k, d in wanted:
        inertia[k] = inertia.get(k, 0) + d
    assert rows == sorted(
        (i, k, d, inertia[k], sum(inertia.values()), laesa.centroid_digest(centroids[k])) for i, k, d in wanted
    )
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
        assert sorted(connection.execute(laesa.SQL).fetchall()) == rows
