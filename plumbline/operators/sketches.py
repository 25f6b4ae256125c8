"""Approximate quartile fences from stored, mergeable sketches (opt-in form of AGG3).

`fit_fences` reads a table several times to know its quartiles exactly.  Here one scan leaves a KLL
sketch of fixed size per numeric column and part of the table.  Sketches are kept as a table; those
of new parts are appended and old parts are never read again.  Merging gives quartiles whose rank
is off by no more than `rank_error` of the values, with 99 % confidence each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.operators.order_stats import finite, whole
from plumbline.operators.profile import FENCE_MIN_VALUES, Fences, numeric_names

SKETCH_SIZE = 2_000
_MERGE_FANOUT = 256
# The published error of a KLL sketch of size k is FACTOR / k ** POWER.
_ERROR_FACTOR, _ERROR_POWER = 2.296, 0.9723
_COLUMNS_PER_SCAN = 4


def rank_error(size: int = SKETCH_SIZE) -> float:
    """Share of all values by which the rank of a quantile may be off."""
    return _ERROR_FACTOR / size**_ERROR_POWER


def column_sketches(
    table: DataFrame, part: Column | None = None, key: str | None = None, size: int = SKETCH_SIZE
) -> DataFrame:
    """(part, column, non_null, sketch) for each numeric column and value of ``part``.

    ``table`` is normalized.  Each task merges its own rows first, so a part that holds most rows
    is no hot key; NaN is null here and infinities are the largest numbers.  A column without
    values in a part has a null sketch.  Without numeric columns, and for an empty table, there
    are no rows."""
    names = numeric_names(table, key)
    by = (F.lit(None).cast("string") if part is None else part.cast("string")).alias("part")
    found = table.sparkSession.createDataFrame([], "part string, column string, non_null long, sketch binary")
    for start in range(0, len(names), _COLUMNS_PER_SCAN):
        group = names[start : start + _COLUMNS_PER_SCAN]
        values = [F.nanvl(quoted(n).cast("double"), F.lit(None).cast("double")) for n in group]
        plain = table.select(by, *[F.when(v.isNotNull(), finite(v)).alias(f"v{i}") for i, v in enumerate(values)])
        # Sketches of a fixed size per task group, then per part.
        split = plain.groupBy("part", F.pmod(F.spark_partition_id(), F.lit(_MERGE_FANOUT)).alias("tasks"))
        partial = split.agg(
            *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(group))],
            *[F.kll_sketch_agg_double(f"v{i}", F.lit(size)).alias(f"s{i}") for i in range(len(group))],
        )
        merged = partial.groupBy("part").agg(
            *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(group))],
            *[F.kll_merge_agg_double(f"s{i}").alias(f"s{i}") for i in range(len(group))],
        )
        rows = F.array(
            *[
                F.struct(
                    F.lit(name).alias("column"),
                    F.col(f"n{i}").alias("non_null"),
                    F.when(F.col(f"n{i}") > 0, F.col(f"s{i}")).alias("sketch"),
                )
                for i, name in enumerate(group)
            ]
        )
        found = found.unionAll(merged.select("part", F.inline(rows)))
    return found


def sketched_quantiles(sketches: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(column, non_null, values): approximate quantiles over all parts of stored sketches.

    ``values`` is null for columns without values."""
    by_part = F.pmod(F.xxhash64("part"), F.lit(_MERGE_FANOUT)).alias("parts")
    partial = sketches.groupBy("column", by_part).agg(
        F.sum("non_null").alias("non_null"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    merged = partial.groupBy("column").agg(
        F.sum("non_null").alias("non_null"), F.kll_merge_agg_double("sketch").alias("sketch")
    )
    wanted = F.array(*[F.lit(float(share)) for share in shares])
    values = F.when(F.col("non_null") > 0, F.kll_sketch_get_quantile_double("sketch", wanted))
    return merged.select("column", "non_null", values.alias("values"))


def approximate_fences(sketches: DataFrame) -> list[Fences]:
    """AGG3 from stored sketches, for columns with enough values; the form of `fit_fences`, so all
    that takes its fences takes these."""
    # One row per column.
    rows = sketched_quantiles(sketches, (0.25, 0.75)).orderBy("column").collect()
    return [
        Fences(row["column"], row["non_null"], *[whole(v) for v in row["values"]])
        for row in rows
        if row["non_null"] >= FENCE_MIN_VALUES
    ]
