"""Quality runs over files as they arrive (STM1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.limits import DEFAULT_LIMITS, Limits
from plumbline.plans.batch_run import FILE, run_quality_batch
from plumbline.plans.quality_run import TRUST_THRESHOLD

# Files of a batch; what the driver holds grows with it, and so does what one batch shares.
FILES_PER_BATCH = 100


def landing_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    kind: str = "parquet",
    glob: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """Files landing in a folder, many per micro-batch, each row with its file in ``__file``."""
    reader = (
        spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files_per_batch)
    )
    if kind == "csv":
        reader = reader.option("header", True).option("escape", '"')
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # A path is escaped like a web address; most have nothing to decode, row by row.
    path = F.col("_metadata.file_path")
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return reader.load(folder).withColumn(FILE, F.when(path.contains("%"), decoded).otherwise(path))


def ingest(
    stream: DataFrame,
    source_name: str,
    history: str,
    checkpoint: str,
    exports: str | None = None,
    reports: str | None = None,
    scorer: str = "forest",
    threshold: float = TRUST_THRESHOLD,
    key: str | None = None,
    created_at: dt.datetime | None = None,
    limits: Limits = DEFAULT_LIMITS,
    index: str | None = None,
) -> StreamingQuery:
    """Measures, scores, cleans and records each file of each micro-batch, then stops when none is
    left.  All files of a batch share its passes.

    A batch may be repeated after a failure.  Its runs are keyed by the batch number and the file,
    so the repetition replaces history rows, reports and exports instead of adding to them.  A
    batch whose runs could not be recorded fails, so that it is repeated."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        done = run_quality_batch(
            batch,
            key=key,
            scorer=scorer,
            threshold=threshold,
            history=history,
            reports=reports,
            exports=exports,
            export_format="parquet",
            run_key=f"{source_name}-{batch_id}",
            created_at=created_at,
            limits=limits,
            index=index,
        )
        if done.failures:
            raise RuntimeError(f"batch {batch_id} of {source_name} was not recorded: {done.failures}")

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
