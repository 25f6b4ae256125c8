"""Trust score by a random forest (TRU1, TRU3 to TRU7).

The forest is fitted once and kept with a table of its leaf values.  Scoring adds one
leaf-number vector per metrics row and looks the leaf values up with a join, so the spread
between trees comes from one transform instead of one per tree.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.rounding import round_exact
from plumbline.operators.profile import QUALITY_FEATURES
from plumbline.operators.trust import (
    FEATURE_LABELS,
    clip_score,
    confidence_level,
    penalty_score,
)
from plumbline.storage import shared_folder

# The training table and the forest grown on it.
TRAINING_ROWS = 1_500
TRAINING_RANGES = {
    "missing_pct": 70.0,
    "duplicate_pct": 60.0,
    "outlier_pct": 40.0,
    "type_inconsistency_pct": 50.0,
    "null_col_ratio": 80.0,
    "constant_col_ratio": 30.0,
    "avg_skewness": 12.0,
}
NOISE_STD = 1.5
SEED = 42
TREES = 200
DEPTH = 12
MIN_LEAF_ROWS = 5

_ROW = "__metrics_row"
_loaded: dict[tuple[str, str], Forest] = {}


@dataclass(frozen=True)
class Forest:
    model: PipelineModel
    # (tree, leaf, prediction): at most TREES x 2^DEPTH rows whatever is scored.
    leaves: DataFrame

    @property
    def importances(self) -> dict[str, float]:
        raw = self.model.stages[-1].featureImportances.toArray()
        return {
            FEATURE_LABELS[name]: round(float(share) / float(raw.sum()) * 100.0, 2)
            for name, share in zip(QUALITY_FEATURES, raw)
        }


def _uniform(seed: int, place: int) -> Column:
    """A number in [0, 1) from the digest of seed, column and row, the same in any engine and
    however rows are split."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(place)), F.col("row").cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def training_table(spark: SparkSession, rows: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """TRU1: ``row``, uniform metrics and the noisy penalty score."""
    features = [
        (_uniform(seed, place) * TRAINING_RANGES[name]).alias(name)
        for place, name in enumerate(QUALITY_FEATURES)
    ]
    # Two uniform numbers make a normal one.
    first, second = (_uniform(seed, len(features) + i) for i in (0, 1))
    normal = F.sqrt(-2.0 * F.log(1.0 - first)) * F.cos(2.0 * math.pi * second)
    return (
        spark.range(0, rows, 1, 1)
        .withColumnRenamed("id", "row")
        .select("row", *features, (normal * NOISE_STD).alias("noise"))
        .withColumn("trust_score", penalty_score(F.col("noise")))
        .drop("noise")
    )


def fit_forest(spark: SparkSession, path: str) -> None:
    """TRU3, TRU4: scale, grow and store the forest and its leaf table under ``path``."""
    stages = [
        VectorAssembler(inputCols=list(QUALITY_FEATURES), outputCol="__raw"),
        MinMaxScaler(inputCol="__raw", outputCol="__features"),
        RandomForestRegressor(
            featuresCol="__features",
            labelCol="trust_score",
            predictionCol="__prediction",
            leafCol="__leaves",
            numTrees=TREES,
            maxDepth=DEPTH,
            minInstancesPerNode=MIN_LEAF_ROWS,
            featureSubsetStrategy="sqrt",
            seed=SEED,
            maxMemoryInMB=1024,
        ),
    ]
    training = training_table(spark).cache()
    model = Pipeline(stages=stages).fit(training)
    training.unpersist()
    model.write().overwrite().save(f"{path}/model")
    model.stages[-1].write().overwrite().save(f"{path}/trees")
    # Leaves are numbered per tree from left to right, the order of node ids.
    order = Window.partitionBy("treeID").orderBy("nodeData.id")
    leaves = (
        spark.read.parquet(f"{path}/trees/data")
        .where("nodeData.leftChild < 0")
        .select(
            F.col("treeID").alias("tree"),
            (F.row_number().over(order) - 1).alias("leaf"),
            F.col("nodeData.prediction").alias("prediction"),
        )
    )
    leaves.coalesce(1).write.mode("overwrite").parquet(f"{path}/leaves")


def scaled_training_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """TRU3: the training table with ``scaled``, its metrics as the stored forest sees them."""
    model = load_forest(spark, path).model
    raw = model.stages[0].transform(training_table(spark))
    return model.stages[1].transform(raw).withColumn("scaled", vector_to_array("__features")).drop("__raw", "__features")


def tree_agreement(metrics: DataFrame, path: str | None = None) -> DataFrame:
    """TRU4, TRU5, AGG15: per row of metrics the model's own ``prediction`` next to the number, mean
    and spread of the leaf values that scoring looks up."""
    forest = load_forest(metrics.sparkSession, path)
    columns = metrics.columns
    reached = forest.model.transform(metrics.withColumn(_ROW, F.monotonically_increasing_id())).select(
        _ROW, F.struct(*columns).alias("row"), F.col("__prediction").alias("prediction"),
        F.posexplode(vector_to_array("__leaves")).alias("tree", "leaf"),
    )
    leaves = forest.leaves.withColumnRenamed("prediction", "value")
    found = reached.withColumn("leaf", F.col("leaf").cast("int")).join(F.broadcast(leaves), ["tree", "leaf"])
    told = found.groupBy(_ROW).agg(
        F.first("row").alias("row"), F.first("prediction").alias("prediction"), F.count("*").alias("trees"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"),
    )
    return told.select("row.*", "prediction", "trees", "mean", "spread")


def load_forest(spark: SparkSession, path: str | None = None) -> Forest:
    """The stored forest; fitted on first use when ``path`` holds none yet."""
    path = path or f"{shared_folder(spark)}/plumbline/forest-md5-{TREES}-{DEPTH}-{SEED}"
    known = (spark.sparkContext.applicationId, path)
    if known not in _loaded:
        try:
            leaves = spark.read.parquet(f"{path}/leaves")
        except AnalysisException:
            fit_forest(spark, path)
            leaves = spark.read.parquet(f"{path}/leaves")
        _loaded[known] = Forest(PipelineModel.load(f"{path}/model"), leaves)
    return _loaded[known]


def forest_score(metrics: DataFrame, path: str | None = None) -> DataFrame:
    """TRU5 to TRU8 for any number of metrics rows."""
    forest = load_forest(metrics.sparkSession, path)
    columns = metrics.columns
    numbered = metrics.withColumn(_ROW, F.monotonically_increasing_id())
    reached = forest.model.transform(numbered).select(
        _ROW,
        F.struct(*columns).alias("row"),
        F.posexplode(vector_to_array("__leaves")).alias("tree", "leaf"),
    )
    spread = (
        reached.withColumn("leaf", F.col("leaf").cast("int"))
        .join(F.broadcast(forest.leaves), ["tree", "leaf"])
        .groupBy(_ROW)
        .agg(
            F.first("row").alias("row"),
            F.avg("prediction").alias("mean"),
            F.stddev_pop("prediction").alias("spread"),
        )
    )
    importances = F.create_map(
        *[F.lit(item) for pair in forest.importances.items() for item in pair]
    )
    return spread.select(
        "row.*",
        round_exact(clip_score(F.col("mean")), 2).alias("trust_score"),
        round_exact(F.col("spread"), 2).alias("std_dev"),
        confidence_level(F.col("spread")).alias("confidence_level"),
        importances.alias("importances"),
    )
