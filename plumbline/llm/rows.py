"""Row keys for stages that decide about rows, where ids may be null or repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.storage import settle

_FAR = 1 << 62
# Keys that every task holds at once; about 50 bytes each.
KEYS_AT_ONCE = 1 << 21


def with_row_keys(docs: DataFrame, name: str, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with a whole number of its own for each row in the column ``name``.

    A row whose id no other has keeps it as its key.  Rows with a null or repeated id get numbers
    beyond all ids; only these are written, once, so that their numbers stay.  Of equal documents
    the smallest key is thus that of a row with an id of its own, if there is one."""
    ident = F.col(f"`{id_column}`").cast("long")
    counted = docs.select(ident.alias("id")).groupBy("id").agg(F.count("*").alias("rows"))
    counted = settle(counted, "ids")
    repeated = counted.where("id is not null and rows > 1").select(F.col("id").alias("__repeated"))
    if counted.where("id is null or rows > 1").isEmpty():
        return docs.withColumn(name, ident)
    low, high = counted.agg(F.min("id"), F.max("id")).first()
    number = F.monotonically_increasing_id()
    if high is None or high < _FAR:
        beyond = number + F.lit((high if high is not None else -1) + 1)
    elif low > -_FAR:
        beyond = F.lit(low - 1) - number
    else:
        # Ids reach both ends of the numbers: every row gets a new one.
        return settle(docs.withColumn(name, number), "row-keys")
    alone = docs.where(ident.isNotNull()).join(repeated, ident == F.col("__repeated"), "left_anti")
    others = docs.where(ident.isNull()).unionByName(
        docs.join(repeated, ident == F.col("__repeated"), "left_semi")
    )
    return alone.withColumn(name, ident).unionByName(settle(others.withColumn(name, beyond), "row-keys"))


def without_rows(keyed: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``keyed`` without the rows whose key ``name`` is in ``gone``.

    These keys are written once.  As many as a task can hold go to the rows, so that no text is
    shuffled; only more than that are joined by a shuffle."""
    gone = settle(gone.select(name), "gone-keys")
    few = gone.count() <= KEYS_AT_ONCE
    return keyed.join(F.broadcast(gone) if few else gone, name, "left_anti")
