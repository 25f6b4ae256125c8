"""The stored index of report texts (REP4).

Documents are dealt to a fixed number of buckets by the hash of their id.  An upsert reads and
rewrites the buckets of the changed documents only, whatever the size of the rest, and publishes
them as the next version; a session that reads meanwhile keeps the version it started with.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.versions import BUCKET, Version, VersionedTable, hash_bucket
from plumbline.storage import settle

# Buckets of a new index: the larger, the less an upsert rewrites and the more files there are.
BUCKETS = 64
_FRESH, _AGE = "__fresh", "__age"


def _plain(schema: T.StructType) -> T.StructType:
    """Columns that may be null, as files have them."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


def upsert_reports(changes: DataFrame, path: str, version: str = "version", buckets: int = BUCKETS) -> int:
    """REP4: stores the changes and returns how many buckets were rewritten.

    A change replaces the stored row of its ``doc_id``; of several changes to one document the one
    with the highest ``version`` does.  Changes without an id are no documents.  The first save
    decides the columns and the number of buckets; later changes must have these columns.
    Writers may save at the same time: one whose buckets were changed meanwhile starts again."""
    spark = changes.sparkSession
    named = settle(changes.where(F.col("doc_id").isNotNull()), "changes")

    def table(found: Version) -> VersionedTable:
        stored = found.facts.get("schema")
        return VersionedTable(
            spark, path, T.StructType.fromJson(json.loads(stored)) if stored else _plain(named.schema)
        )

    def attempt(found: Version):
        target = table(found)
        names = target.schema.fieldNames()
        if set(names) != set(named.columns):
            raise ValueError(f"the index has the columns {names}, the changes {named.columns}")
        number = found.facts.get("buckets", buckets)
        fresh = named.select(*names).withColumn(BUCKET, hash_bucket("doc_id", number))
        touched = {row[0] for row in fresh.select(BUCKET).distinct().collect()}
        if not touched:
            return {}, {}, 0
        old = target.rows(found, touched).withColumn(BUCKET, hash_bucket("doc_id", number))
        rows = old.withColumn(_FRESH, F.lit(False)).unionByName(fresh.withColumn(_FRESH, F.lit(True)))
        # One exchange: documents of a bucket are in one task, which the window needs, too.
        order = Window.partitionBy(BUCKET, "doc_id").orderBy(F.desc(_FRESH), F.desc(version))
        latest = rows.repartition(BUCKET).withColumn(_AGE, F.row_number().over(order)).where(F.col(_AGE) == 1)
        written = target.write(latest.drop(_FRESH, _AGE))
        facts = {"buckets": number, "schema": json.dumps(target.schema.jsonValue())}
        return written, facts, len(touched)

    store = VersionedTable(spark, path, _plain(named.schema))
    if named.isEmpty():
        return 0
    return store.change(attempt)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """REP4: all documents of the latest version, for ``text_topk`` and others."""
    found = VersionedTable(spark, path, "doc_id string").latest()
    if not found.facts:
        raise ValueError(f"no report index under {path}")
    schema = T.StructType.fromJson(json.loads(found.facts["schema"]))
    return VersionedTable(spark, path, schema).rows(found)


def find_report(spark: SparkSession, path: str, doc_id: str) -> DataFrame:
    """One document or none; only the files of its bucket are opened."""
    found = VersionedTable(spark, path, "doc_id string").latest()
    if not found.facts:
        raise ValueError(f"no report index under {path}")
    schema = T.StructType.fromJson(json.loads(found.facts["schema"]))
    wanted = spark.range(1).select(F.lit(doc_id).cast(schema["doc_id"].dataType).alias("doc_id"))
    bucket = wanted.select(hash_bucket("doc_id", found.facts["buckets"])).first()[0]
    return VersionedTable(spark, path, schema).rows(found, {bucket}).where(F.col("doc_id") == doc_id)
