"""Input relations of the checks, the same in Spark and in the expected-result SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Columns by kind (n numeric, t text, o other) of the plain tables that are profiled.
KINDS = {
    "customer": {
        "c_custkey": "n", "c_name": "t", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "t",
    },
    "part": {
        "p_partkey": "n", "p_name": "t", "p_brand": "t", "p_type": "t", "p_size": "n",
        "p_retailprice": "n",
    },
    "events": {
        "event_id": "n", "ts": "o", "user_id": "n", "event_type": "t", "value": "n", "props": "t",
    },
    "lineitem": {
        "l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n",
        "l_quantity": "n", "l_extendedprice": "n", "l_discount": "n", "l_tax": "n",
        "l_returnflag": "t", "l_linestatus": "t", "l_shipdate": "o",
    },
    "dirty": {
        "o_orderkey": "n", "amount": "n", "price": "n", "priority": "t", "mixed_ref": "t",
        "tag": "t", "source": "t", "empty_num": "n", "empty_txt": "t", "status": "t",
    },
    "gaps": {"quality": "n", "toxic": "n", "grade": "t"},
}

# Orders made dirty: nulls, outliers, markers, mixed types, constants and copies.  The row
# key takes no part in the metrics.
DIRTY = """
  SELECT o_orderkey * 2 + copy AS row_id, o_orderkey,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL
         WHEN o_orderkey % 101 = 0 THEN o_totalprice * 50
         ELSE o_totalprice END AS amount,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS price,
    CASE WHEN o_orderkey % 13 = 0 THEN ' N/A '
         WHEN o_orderkey % 17 = 0 THEN 'Unknown'
         ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS STRING)
         ELSE concat('c-', CAST(o_custkey AS STRING)) END AS mixed_ref,
    CASE WHEN o_orderkey % 19 = 0 THEN '--'
         ELSE concat('tag', CAST(o_orderkey AS STRING)) END AS tag,
    'K' AS source,
    CAST(NULL AS DOUBLE) AS empty_num,
    CAST(NULL AS STRING) AS empty_txt,
    o_orderstatus AS status
  FROM (SELECT *, CAST(0 AS BIGINT) AS copy FROM {orders}
        UNION ALL
        SELECT *, CAST(1 AS BIGINT) AS copy FROM {orders} WHERE o_orderkey % 20 = 0) doubled
"""

# Few distinct rows with gaps: filling them makes rows equal that were not.
GAPS = """
  SELECT doc_id AS row_id,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE quality END AS quality,
    toxic,
    CASE WHEN doc_id % 4 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'b' ELSE 'a' END AS grade
  FROM {labels}
"""

# Documents as reports: the head names a run and a data set, the body is the text.
REPORT_TEXT = """
  SELECT CAST(doc_id AS STRING) AS doc_id,
    concat('folder/', source, '/', CAST(doc_id AS STRING), '.txt') AS report_path,
    concat(
      'Quality of one table', chr(10),
      CASE WHEN doc_id % 10 = 3 THEN 'Run ID: pending'
           WHEN doc_id % 10 = 4 THEN 'No run'
           ELSE concat('Run ID:  ', CAST(doc_id AS STRING), ' ') END, chr(10),
      CASE WHEN doc_id % 10 = 5 THEN 'No name'
           ELSE concat('Dataset Name: ', source, '.csv') END, chr(10),
      chr(10), text) AS text
  FROM {documents}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY, orders=table(spark, sf_dir, "orders"))


def land(df: DataFrame, column: str, folder: str, name: str) -> None:
    """One Parquet file ``<name>_<value>.parquet`` for each value of a column, as if others had put
    it there."""
    spark = df.sparkSession
    df.repartition(column).write.partitionBy(column).parquet(f"{folder}-parts")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path(folder))
    for part in system.listStatus(path(f"{folder}-parts")):
        if not part.isDirectory():
            continue
        value = part.getPath().getName().partition("=")[2]
        (source,) = [f.getPath() for f in system.listStatus(part.getPath()) if f.getPath().getName().endswith(".parquet")]
        system.rename(source, path(f"{folder}/{name}_{value}.parquet"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GAPS, labels=table(spark, sf_dir, "labels"))


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REPORT_TEXT, documents=table(spark, sf_dir, "documents"))
