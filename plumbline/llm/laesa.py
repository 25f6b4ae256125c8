"""Centroid clustering over a LAESA pivot table, in exact integers.

Vectors become integer grid points.  Their distances to a few fixed pivots are computed once and
stored beside them.  In a round each centroid is as far from the pivots as the driver finds, and
the differences of these distances bound the distance of every vector to every centroid from
below (triangle inequality).  The centroid with the smallest bound is measured first; those whose
bound is beyond the best distance so far are out, and only the others are measured, in integers.
Bounds are floating-point numbers taken a little smaller than they are, so none is out wrongly.

Rounds are scans of the stored table.  A task sums its vectors by centroid, Spark adds the sums,
and the driver sees one number per centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.storage import settle

CENTROIDS, ROUNDS, COMPONENTS, SCALE, PIVOTS = 16, 3, 64, 64, 8
# Largest component on the grid: squared distances of COMPONENTS of them stay below 2**63.
_LARGEST = 1 << 27
# Vectors measured at once by a task.
_MEASURED = 8192


def _flat(column: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` values as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one integer row."""
    apart = points - centre
    return np.einsum("ij,ij->i", apart, apart)


def choose_pivots(candidates: np.ndarray, number: int) -> np.ndarray:
    """Of the candidates the first, then again and again the one farthest from those chosen by
    the sum of distances; the first of equal ones.  Equal candidates are taken once."""
    chosen = list(range(min(1, len(candidates))))
    summed = np.zeros(len(candidates))
    gone = np.zeros(len(candidates), bool)
    while chosen and len(chosen) < number:
        apart = squared(candidates, candidates[chosen[-1]])
        gone |= apart == 0
        summed += np.sqrt(apart.astype(np.float64))
        if gone.all():
            break
        chosen.append(int(np.argmax(np.where(gone, -1.0, summed))))
    return candidates[chosen]


def assign(
    points: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each point (the smaller number of equally near ones), the squared
    distance to it, and how many distances were computed for that."""
    far = np.sqrt(to_pivots.astype(np.float64))
    bounds = np.zeros((len(points), len(centroids)))
    for k, centroid in enumerate(centroids):
        centre = np.sqrt(squared(pivots, centroid).astype(np.float64))
        bounds[:, k] = np.abs(far - centre).max(axis=1, initial=0.0)
    # Square roots and differences are off by less than this.
    bounds = np.maximum(bounds - 1e-9 * (1.0 + far.max(axis=1, initial=0.0, keepdims=True)) * 4, 0.0) ** 2
    bounds *= 1.0 - 1e-12
    first = bounds.argmin(axis=1)
    cluster = first.copy()
    best = np.empty(len(points), np.int64)
    for k in range(len(centroids)):
        mine = np.flatnonzero(first == k)
        best[mine] = squared(points[mine], centroids[k])
    measured = len(points)
    for k in range(len(centroids)):
        asked = np.flatnonzero((bounds[:, k] <= best) & (first != k))
        distance = squared(points[asked], centroids[k])
        better = (distance < best[asked]) | ((distance == best[asked]) & (k < cluster[asked]))
        best[asked[better]], cluster[asked[better]] = distance[better], k
        measured += len(asked)
    return cluster, best, measured


def grid_points(
    vectors: DataFrame, id_column: str, vector_column: str, components: int, scale: int
) -> DataFrame:
    """``vec_id`` and ``point`` (``floor(scale * x)`` of each component) of the vectors with just
    ``components`` components, all of them finite numbers.  Ids repeat as they do in ``vectors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), components), False)
            kept = batch.filter(right)
            # A null component reads as a NaN.
            values = _flat(kept.column(1), components).astype(np.float64)
            finite = np.isfinite(values).all(axis=1)
            values = np.floor(values[finite] * scale)
            if values.size and np.abs(values).max() > _LARGEST:
                raise ValueError(f"components beyond {_LARGEST / scale} have no exact distances")
            flat = pa.array(values.astype(np.int32).ravel())
            starts = pa.array(np.arange(len(values) + 1, dtype=np.int32) * components)
            yield pa.RecordBatch.from_arrays(
                [kept.column(0).filter(pa.array(finite)), pa.ListArray.from_arrays(starts, flat)],
                ["vec_id", "point"],
            )

    kind = vectors.schema[id_column].dataType.simpleString()
    chosen = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector"))
    return chosen.mapInArrow(run, f"vec_id {kind}, point array<int>")


def seed_centroids(points: DataFrame, number: int, seed: int = 1) -> np.ndarray:
    """The points of the ``number`` smallest hashes of seed and id, in that order; points under
    equal ids go by their components, and those without an id come last, by components."""
    told = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    order = [F.asc_nulls_last("hash"), "point"]
    rows = points.withColumn("hash", F.sha2(told, 256)).orderBy(*order).limit(number)
    return np.array([row.point for row in rows.select("point").collect()], np.int64)


def pivot_table(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vec_id``, ``point`` and ``far``, the squared distances to the pivots; written once."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _flat(batch.column(1), width).astype(np.int64)
            far = np.stack([squared(at, pivot) for pivot in pivots], axis=1)
            starts = pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(pivots))
            lists = pa.ListArray.from_arrays(starts, pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["vec_id", "point", "far"])

    kind = points.schema["vec_id"].dataType.simpleString()
    return settle(points.mapInArrow(run, f"vec_id {kind}, point array<int>, far array<long>"), "pivots")


def _nearest(centroids: np.ndarray, pivots: np.ndarray):
    """Parts of the pivot table's batches with their points, clusters, distances and effort."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start in range(0, batch.num_rows, _MEASURED):
                part = batch.slice(start, _MEASURED)
                points = _flat(part.column(part.schema.get_field_index("point")), width).astype(np.int64)
                far = _flat(part.column(part.schema.get_field_index("far")), len(pivots))
                yield part, points, *assign(points, far, centroids, pivots)

    return run


def assign_all(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``vec_id``, ``cluster`` and ``distance`` (squared) of every vector of the pivot table."""
    nearest = _nearest(centroids, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, cluster, best, _ in nearest(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(cluster.astype(np.int32)), pa.array(best)],
                ["vec_id", "cluster", "distance"],
            )

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def move_centroids(
    table: DataFrame, centroids: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, int, int]:
    """One round: the floors of the means of each centroid's vectors (a centroid without any
    stays), and how many vectors there are and how many distances were computed."""
    nearest = _nearest(centroids, pivots)
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), width + 2), np.int64)
        for _, points, cluster, _, measured in nearest(batches):
            for k in np.unique(cluster):
                mine = points[cluster == k]
                sums[k, :width] += mine.sum(axis=0)
                sums[k, width] += len(mine)
            sums[0, width + 1] += measured
        cluster, place = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sums[cluster, place])],
            ["cluster", "place", "value"],
        )

    # A few numbers per centroid and component, whatever the table's size.
    added = (
        table.select("point", "far")
        .mapInArrow(run, "cluster int, place int, value long")
        .groupBy("cluster", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    sums = np.zeros((len(centroids), width + 2), np.int64)
    for row in added:
        sums[row.cluster, row.place] = row.value
    count = sums[:, width]
    moved = centroids.copy()
    there = count > 0
    moved[there] = sums[there, :width] // count[there, None]
    return moved, int(count.sum()), int(sums[0, width + 1])


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(value)) for value in centroid).encode()).hexdigest()


def cluster_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    seed: int = 1,
) -> tuple[DataFrame, np.ndarray, list[float]]:
    """``vec_id``, ``cluster`` and ``distance`` of every usable vector, the final centroids, and the
    share of all vector-centroid distances that each round had to compute.

    Vectors that are null, of another length, or with a null or non-finite component are left out;
    a component beyond ``2**27 / scale`` raises an error, as its distances would not fit a long.
    Repeated rows and ids are vectors each, vectors without an id are clustered but come last as
    first centroids, and with fewer vectors than ``centroids`` each is one.  Ties go to the smaller
    centroid.  Other columns are not used."""
    points = grid_points(vectors, id_column, vector_column, components, scale)
    centres = seed_centroids(points, centroids, seed)
    if not len(centres):
        kind = points.schema["vec_id"].dataType.simpleString()
        none = vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long")
        return none, centres, []
    fixed = choose_pivots(centres, pivots)
    table, shares = pivot_table(points, fixed), []
    for _ in range(rounds):
        centres, rows, measured = move_centroids(table, centres, fixed)
        shares.append(measured / (rows * len(centres)))
    return assign_all(table, centres, fixed), centres, shares


def op12_laesa_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, with the inertia of their clusters and of all."""
    clustered, centres, _ = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    clustered = settle(clustered, "clusters")
    # One row per centroid.
    inertia = {r.cluster: r.sum for r in clustered.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    told = spark.createDataFrame(
        [(k, inertia[k], sum(inertia.values()), centroid_digest(centres[k])) for k in sorted(inertia)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return clustered.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


_START = f"""
WITH RECURSIVE kept AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x:
    CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS point FROM embeddings
  WHERE len(embedding) = {COMPONENTS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
place AS (SELECT unnest(range(1, {COMPONENTS} + 1)) AS p),
cells AS (SELECT row, p, point[p] AS x FROM kept, place),
c0 AS (
  SELECT k - 1 AS k, p, point[p] AS x FROM place,
    (SELECT point, row_number() OVER (ORDER BY sha256('1:' || vec_id), point) AS k FROM kept
     QUALIFY k <= {CENTROIDS}))"""
_ROUND = """,
d{n} AS (
  SELECT row, k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM cells v JOIN c{n} c USING (p) GROUP BY row, k),
a{n} AS (SELECT row, k, d FROM d{n} QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1)"""
_MOVE = """,
m{n} AS (
  SELECT k, p, sum(x) AS s, count(*) AS n FROM cells JOIN a{n} USING (row) GROUP BY k, p),
c{next} AS (
  SELECT k, p, CASE WHEN n IS NULL THEN x
    ELSE (CAST(s AS BIGINT) - (((CAST(s AS BIGINT) % n) + n) % n)) // n END AS x
  FROM c{n} LEFT JOIN m{n} USING (k, p))"""
SQL = (
    _START
    + "".join(_ROUND.format(n=n) + _MOVE.format(n=n, next=n + 1) for n in range(ROUNDS))
    + _ROUND.format(n=ROUNDS)
    + f""",
hashed AS (
  SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256
  FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN a{ROUNDS} USING (row) JOIN hashed USING (k)
"""
)
