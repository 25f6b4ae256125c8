"""Vectors in random-projection buckets: exact or approximate top k without reading all (RET2 at scale).

The index is built once.  Unit vectors are projected on a few random orthonormal directions; on
which side of the median the first projections lie names the bucket, and vectors lie in folders
by bucket.  Beside them each bucket keeps the smallest and largest projection per direction.

Projecting shortens distances, so the box of a bucket bounds the cosine of all its vectors.  A
question first reads the buckets whose mean projection points its way; the k-th best score found
there is a threshold, and of all other buckets only those whose bound reaches it are read.  So the
result is that of scoring everything.  With ``exact=False`` the search ends after the first
buckets: no bound is needed then, and the recall is that of `recall_at_k`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.limits import DEFAULT_LIMITS, Limits
from plumbline.operators.retrieve import RESULTS, SCORE_DIGITS, batches, unit_rows
from plumbline.storage import settle

# Sides that name a bucket, and directions that bound it.
SIDES, DIRECTIONS = 8, 32
# Share of rows read at first: to find a threshold, and where nothing follows.
FIRST_SHARE, ONLY_SHARE = 0.05, 0.6
# Projections are stored as floats; scores are rounded.
_SLACK = 1e-5
_MEDIAN_ACCURACY = 1000
# Vectors that are similar to nothing: null components, other lengths, no length.
_ODD = -1
_UNITS_HELD = 2_000_000
_TASKS_PER_SALT = 8


def _dense(column: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors of the right length; the others, and null components, are zero vectors."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False)
    flat = column.filter(fits).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    vectors = np.zeros((len(column), dimensions))
    vectors[fits.to_numpy(zero_copy_only=False)] = flat.reshape(-1, dimensions)
    return unit_rows(vectors)


def _projected(directions: np.ndarray):
    """Adds the projections to (doc_id, vector); null for vectors similar to nothing."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            units = _dense(batch.column(1), directions.shape[1])
            marks = (units @ directions.T).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(marks.ravel()), len(directions))
            odd = pa.array(~units.any(axis=1))
            lists = pc.if_else(odd, pa.scalar(None, pa.list_(pa.float32())), lists.cast(pa.list_(pa.float32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["doc_id", "vector", "marks"])

    return run


def build_vector_index(
    index: DataFrame, path: str, sides: int = SIDES, directions: int = DIRECTIONS, seed: int = 0
) -> None:
    """Writes (doc_id, vector) under ``path`` in up to 2^``sides`` buckets and one for odd vectors.

    The most frequent length is that of the index.  Null vectors are no documents.  Every other row
    is indexed; repeated rows stay repeated."""
    spark = index.sparkSession
    documents = index.where(F.col("vector").isNotNull()).select("doc_id", "vector")
    lengths = documents.groupBy(F.size("vector").alias("length")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    dimensions = max(first["length"], 1) if first else 1
    directions = min(directions, dimensions)
    sides = min(sides, directions)
    drawn = np.random.default_rng(seed).standard_normal((dimensions, directions))
    across = np.linalg.qr(drawn)[0].T
    schema = T.StructType([*documents.schema.fields, T.StructField("marks", T.ArrayType(T.FloatType()))])
    marked = documents.mapInArrow(_projected(across), schema)
    # Mergeable summaries; a median that is a little off makes buckets a little uneven.
    medians = marked.agg(
        *[F.percentile_approx(F.col("marks")[i], 0.5, _MEDIAN_ACCURACY) for i in range(sides)]
    ).first()
    named = [
        F.when(F.col("marks")[i] > F.lit(0.0 if m is None else m), 1 << i).otherwise(0) for i, m in enumerate(medians)
    ]
    bucket = F.coalesce(F.when(F.col("marks").isNotNull(), reduce(lambda a, b: a + b, named)), F.lit(_ODD))
    # A bucket may hold a third of all rows, or copies of one: its rows go by the task that read them.
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // _TASKS_PER_SALT)
    (
        marked.select("*", bucket.cast("int").alias("bucket"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
        .repartition("bucket", "salt")
        .drop("salt")
        .sortWithinPartitions("bucket")
        .write.partitionBy("bucket")
        .parquet(f"{path}/vectors")
    )
    written = spark.read.schema("marks array<float>, bucket int").parquet(f"{path}/vectors")
    rest = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.aggregate("marks", F.lit(0.0), lambda a, x: a + x * x)))

    def of_each(measure) -> Column:
        return F.array(*[measure(F.col("marks")[i].cast("double")) for i in range(directions)])

    written.groupBy("bucket").agg(
        F.count("*").alias("rows"),
        of_each(F.min).alias("lows"),
        of_each(F.max).alias("highs"),
        of_each(F.avg).alias("means"),
        F.min(rest).alias("rest_low"),
        F.max(rest).alias("rest_high"),
    ).coalesce(1).write.parquet(f"{path}/buckets")
    stored = T.StructType([*documents.schema.fields, T.StructField("bucket", T.IntegerType())])
    facts = spark.createDataFrame(
        [(across.tolist(), stored.json())], "directions array<array<double>>, schema string"
    )
    facts.coalesce(1).write.parquet(f"{path}/facts")


@dataclass(frozen=True)
class VectorSearch:
    """``matches`` as ``vector_topk`` gives them; how many vectors times questions there are, and
    how many of them were scored."""

    matches: DataFrame
    all_pairs: int
    scored_pairs: int


@dataclass(frozen=True)
class _Buckets:
    """Numbers per bucket; no more rows than buckets."""

    names: np.ndarray
    rows: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    means: np.ndarray
    rest_low: np.ndarray
    rest_high: np.ndarray

    @staticmethod
    def read(spark: SparkSession, path: str, directions: int) -> _Buckets:
        table = spark.read.parquet(f"{path}/buckets").toPandas().sort_values("bucket")
        odd = (table["bucket"] == _ODD).to_numpy()

        def wide(name: str) -> np.ndarray:
            values = [[0.0] * directions if o else list(v) for o, v in zip(odd, table[name])]
            return np.array(values, dtype="float64").reshape(-1, directions)

        return _Buckets(
            table["bucket"].to_numpy(),
            table["rows"].to_numpy(),
            *[wide(name) for name in ("lows", "highs", "means")],
            *[table[name].fillna(0.0).to_numpy(dtype="float64") for name in ("rest_low", "rest_high")],
        )

    def bounds(self, units: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """What the cosine of no vector in a bucket exceeds, per question and bucket."""
        squares = np.zeros((len(units), len(self.names)))
        for i in range(marks.shape[1]):
            at = marks[:, i, None]
            squares += np.maximum(np.maximum(self.lows[:, i] - at, at - self.highs[:, i]), 0.0) ** 2
        rest = np.sqrt(np.maximum(1.0 - (marks**2).sum(axis=1), 0.0))[:, None]
        squares += np.maximum(np.maximum(self.rest_low - rest, rest - self.rest_high), 0.0) ** 2
        bounds = 1.0 - squares / 2.0
        bounds[:, self.names == _ODD] = 0.0
        bounds[~units.any(axis=1)] = 0.0
        return bounds + _SLACK

    def first(self, marks: np.ndarray, share: float) -> np.ndarray:
        """The most promising buckets that hold a ``share`` of all rows, per question."""
        order = np.argsort(-(marks @ self.means.T), axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        chosen = np.empty(order.shape, dtype=bool)
        np.put_along_axis(chosen, order, before < share * self.rows.sum(), axis=1)
        return chosen


def _task(asked: np.ndarray, units: np.ndarray, names: np.ndarray, chosen: np.ndarray, k: int):
    """The k best of a task among the chosen (question, bucket)."""
    step = max(1, _UNITS_HELD // max(len(asked), units.shape[1]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in rows:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                vectors = _dense(part.column(1), units.shape[1])
                ids = part.column(0).to_pandas().to_numpy()
                places = np.searchsorted(names, part.column(2).to_numpy(zero_copy_only=False))
                found = [] if best is None else [best]
                for place in np.unique(places):
                    asking, here = np.flatnonzero(chosen[:, place]), np.flatnonzero(places == place)
                    if not len(asking):
                        continue
                    scores = np.round(units[asking] @ vectors[here].T, SCORE_DIGITS) + 0.0
                    least = np.full(len(asking), -np.inf)
                    if len(here) > k:
                        # At least the k best of these, and all that tie with the last of them.
                        least = np.partition(scores, -k, axis=1)[:, -k]
                    question, row = np.nonzero(scores >= least[:, None])
                    found.append(
                        pd.DataFrame(
                            {"question_id": asked[asking[question]], "doc_id": ids[here[row]], "score": scores[question, row]}
                        )
                    )
                if found:
                    ranked = pd.concat(found).sort_values(
                        ["question_id", "score", "doc_id"], ascending=[True, False, True]
                    )
                    best = ranked.groupby("question_id", sort=False).head(k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return run


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_vectors(
    path: str,
    questions: DataFrame,
    k: int = RESULTS,
    exact: bool = True,
    share: float | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> VectorSearch:
    """RET2 over an index of `build_vector_index`: questions (question_id, vector) of the index's length.

    Null vectors are no questions.  A vector or question without length or with a component that is
    not finite scores 0.  A ``share`` of the rows is read at first; ``exact`` decides whether buckets
    whose bound reaches the k-th best score follow.  Found scores are the same either way."""
    if k < 1:
        raise ValueError("k must be positive")
    if share is None:
        share = FIRST_SHARE if exact else ONLY_SHARE
    spark = questions.sparkSession
    facts = spark.read.parquet(f"{path}/facts").first()
    across = np.array(facts["directions"], dtype="float64")
    dimensions = across.shape[1]
    buckets = _Buckets.read(spark, path, len(across))
    # Without documents there is no file to take the types from.
    stored = T.StructType.fromJson(json.loads(facts["schema"]))
    vectors = spark.read.schema(stored).parquet(f"{path}/vectors").select("doc_id", "vector", "bucket")
    questions = questions.where(F.col("vector").isNotNull()).select("question_id", "vector")
    number, wrong = questions.agg(
        F.count("*"), F.count(F.when(F.size("vector") != dimensions, 1))
    ).first()
    if wrong:
        raise ValueError(f"questions must have {dimensions} components like the index")
    schema = T.StructType(
        [questions.schema["question_id"], vectors.schema["doc_id"], T.StructField("score", T.DoubleType())]
    )
    matches = spark.createDataFrame([], schema)
    all_pairs = scored_pairs = 0
    width = dimensions + len(buckets.names)
    for batch in batches(questions, number * width, limits.question_values):
        asked = batch.toPandas()
        if asked.empty or not len(buckets.names):
            continue
        ids = asked["question_id"].to_numpy()
        units = _dense(pa.array([list(v) for v in asked["vector"]], pa.list_(pa.float64())), dimensions)
        marks = units @ across.T

        def scored(chosen: np.ndarray) -> DataFrame:
            needed = [int(name) for name in buckets.names[chosen.any(axis=0)]]
            read = vectors.where(F.col("bucket").isin(needed))
            found = read.mapInArrow(_task(ids, units, buckets.names, chosen, k), schema)
            return settle(_ranked(found, k).drop("rank"), "vector_matches")

        first = buckets.first(marks, share)
        best = scored(first)
        scored_pairs += int((first @ buckets.rows).sum())
        if exact:
            # One row per question of the batch.
            kth = best.groupBy("question_id").agg(F.count("*").alias("found"), F.min("score").alias("least"))
            least = kth.toPandas().set_index("question_id").reindex(ids)
            threshold = np.where(least["found"].fillna(0) >= k, least["least"].astype("float64"), -np.inf)
            further = (buckets.bounds(units, marks) >= threshold[:, None]) & ~first
            if further.any():
                best = best.unionAll(scored(further))
                scored_pairs += int((further @ buckets.rows).sum())
        matches = matches.unionAll(best)
        all_pairs += len(ids) * int(buckets.rows.sum())
    ranked = _ranked(matches, k).select("question_id", "rank", "doc_id", "score")
    return VectorSearch(ranked, all_pairs, scored_pairs)


def recall_at_k(found: DataFrame, exact: DataFrame) -> float:
    """Share of the ``exact`` matches that are among the ``found`` ones; 1.0 where there are none.

    A document with the score of the last exact match is as good as it."""
    last = exact.groupBy("question_id").agg(F.min("score").alias("last"), F.count("*").alias("wanted"))
    good = found.join(last, "question_id").where(F.col("score") >= F.col("last"))
    hits = good.groupBy("question_id").agg(F.count("*").alias("hits"))
    row = last.join(hits, "question_id", "left").agg(
        F.sum(F.least(F.coalesce("hits", F.lit(0)), "wanted")).alias("hits"), F.sum("wanted").alias("wanted")
    ).first()
    return row["hits"] / row["wanted"] if row["wanted"] else 1.0
