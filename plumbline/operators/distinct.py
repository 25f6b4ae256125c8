"""Duplicate rows: counting them and keeping one copy of each.

A first pass shuffles only a 64-bit digest per row: a digest seen once proves its row unique, so
only rows that share one need the exact grouping on all columns, and none at all if no digest is
shared.  The shared digests go to the tasks as a bitmap of fixed size, which lets all their rows
through and few others; what passes is compared in full, so neither collisions nor a crowded
bitmap change the result.  Map-side grouping turns a row repeated any number of times into one row
per task before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.bitmap import bitmap_of, mark_members
from plumbline.functions.columns import data_fields, is_ordered, quoted
from plumbline.functions.rounding import percentage
from plumbline.limits import DEFAULT_LIMITS, Limits
from plumbline.storage import settle

_DIGEST, _DOUBTFUL = "__row_digest", "__doubtful"


def _comparable(field: T.StructField) -> Column:
    """Maps and variants have no order in Spark: a map is compared as its sorted entries,
    anything that contains them as JSON text."""
    value = quoted(field.name)
    if is_ordered(field):
        return value
    kind = field.dataType
    if isinstance(kind, T.MapType) and is_ordered(T.StructField("value", kind.valueType)):
        return F.array_sort(F.map_entries(value))
    return F.to_json(value)


def _row_values(df: DataFrame, key: str | None) -> list[Column]:
    return [_comparable(field).alias(field.name) for field in data_fields(df, key)]


@dataclass(frozen=True)
class DuplicateSearch:
    """What one digest pass found out about the rows of a table."""

    df: DataFrame
    rows: int
    key: str | None
    # Bitmap of the digests carried by more than one row.
    shared: DataFrame | None = None
    # The result itself, where it is known already.
    distinct: int | None = None

    @property
    def all_unique(self) -> bool:
        return self.distinct == self.rows

    def _marked(self) -> DataFrame:
        """The rows, and whether each may have a copy."""
        tagged = self.df.withColumn(_DIGEST, F.xxhash64(*_row_values(self.df, self.key)))
        return mark_members(tagged, _DIGEST, self.shared, _DOUBTFUL).drop(_DIGEST)

    def _copies(self, *by: str) -> DataFrame:
        """How many rows of each group are copies beyond the first; groups without any may lack."""
        doubtful = self._marked().where(_DOUBTFUL)
        values = _row_values(self.df, self.key)
        names = [f"__value_{i}" for i in range(len(values))]
        groups = [value.alias(name) for value, name in zip(values, names)]
        counted = doubtful.select(*groups, *[quoted(b).alias(f"__by_{b}") for b in by]).groupBy(
            *names, *[f"`__by_{b}`" for b in by]
        )
        extra = counted.agg((F.count("*") - 1).alias("extra")).groupBy(*[f"`__by_{b}`" for b in by])
        return extra.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("extra"))

    def count_distinct(self) -> DataFrame:
        """One row: ``distinct_rows``; nulls equal each other."""
        if self.distinct is not None:
            return self.df.sparkSession.range(1).select(
                F.lit(self.distinct).cast("long").alias("distinct_rows")
            )
        return self._copies().select((F.lit(self.rows) - F.col("extra")).alias("distinct_rows"))

    def copies_by(self, group: str) -> dict:
        """Copies beyond the first per value of a column, which is part of the rows; values
        without any are left out."""
        if self.all_unique:
            return {}
        return {row[0]: row.extra for row in self._copies(group).collect() if row.extra}

    def keep_one(self) -> DataFrame:
        """One copy of each row; with a row key the smallest key survives."""
        if self.all_unique:
            return self.df
        marked = self._marked()
        unique = marked.where(~F.col(_DOUBTFUL)).drop(_DOUBTFUL)
        kept = unique.unionByName(_group_copies(marked.where(_DOUBTFUL).drop(_DOUBTFUL), self.key))
        return kept.select(*[quoted(name) for name in self.df.columns])


def find_duplicates(
    df: DataFrame, rows: int, key: str | None = None, limits: Limits = DEFAULT_LIMITS
) -> DuplicateSearch:
    """The digest pass."""
    digest = F.xxhash64(*_row_values(df, key)).alias(_DIGEST)
    counted = df.select(digest).groupBy(_DIGEST).agg(F.count("*").alias("copies"))
    shared = settle(bitmap_of(counted.where("copies > 1"), _DIGEST), "digests")
    if shared.isEmpty():
        return DuplicateSearch(df, rows, key, distinct=rows)
    return DuplicateSearch(df, rows, key, shared)


def count_distinct_rows(
    df: DataFrame, rows: int, key: str | None = None, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    return find_duplicates(df, rows, key, limits).count_distinct()


def duplicate_summary(
    df: DataFrame, rows: int, key: str | None = None, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """AGG2: copies beyond the first, as a count and as percent of rows."""
    extra = (F.lit(rows).cast("long") - F.col("distinct_rows")).alias("duplicate_count")
    counted = count_distinct_rows(df, rows, key, limits).select(
        F.lit(rows).cast("long").alias("total_rows"), "distinct_rows", extra
    )
    share = percentage(F.col("duplicate_count"), F.col("total_rows")).alias("duplicate_pct")
    return counted.select("*", share)


def distinct_rows(
    df: DataFrame, rows: int, key: str | None = None, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """SET1."""
    return find_duplicates(df, rows, key, limits).keep_one()


def _group_copies(df: DataFrame, key: str | None) -> DataFrame:
    fields = data_fields(df, key)
    unordered = {f.name: f"__value_{i}" for i, f in enumerate(fields) if not is_ordered(f)}
    if key is None and not unordered:
        return df.distinct()
    groups = [_comparable(f).alias(unordered.get(f.name, f.name)) for f in fields]
    kept = [F.first(quoted(name)).alias(name) for name in unordered]
    if key is not None:
        kept.append(F.min(quoted(key)).alias(key))
    return df.groupBy(*groups).agg(*kept).select(*[quoted(name) for name in df.columns])
