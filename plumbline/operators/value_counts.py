"""AGG11, AGG12: non-null count, distinct count and mode of categorical columns.

Values are told apart by 128 bits of hash, so what is shuffled does not depend on how long texts
are.  The mode is the smallest of the values that are there most often.  Its hash is known after
counting, the text is then looked up: the hashes in question, narrowed to those whose first
characters are the smallest, go to the tasks as a bitmap of fixed size, and one scan brings the
smallest text that passes.  A text that passed without being in question shows in the counts, and
the scan is repeated for what is beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.bitmap import bitmap_of, mark_members
from plumbline.functions.columns import quoted
from plumbline.storage import settle, small_table

_PREFIX = 8


def _long_form(df: DataFrame, columns: list[str], group: str | None) -> DataFrame:
    """(part, slot, value): non-null cells as text, one part for all without a group."""
    cells = [
        F.struct(F.lit(slot).alias("slot"), quoted(name).cast("string").alias("value"))
        for slot, name in enumerate(columns)
    ]
    part = (quoted(group) if group else F.lit(0)).alias("part")
    return df.select(part, F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def _hashed(cells: DataFrame) -> DataFrame:
    return cells.select(
        "part",
        "slot",
        F.substring("value", 1, _PREFIX).alias("prefix"),
        # The first hash includes the place, so that one bitmap serves all columns.
        F.xxhash64(F.lit(1), "part", "slot", "value").alias("h1"),
        F.xxhash64(F.lit(2), "value").alias("h2"),
        "value",
    )


@dataclass(frozen=True)
class ValueCounts:
    """How often each value of some columns is there, per part of a table or for all of it.

    ``counted`` is a stored table of hashes; ``summary`` has (part, column) -> non-null cells,
    distinct values and cells of the most frequent value, for columns that have any."""

    df: DataFrame
    columns: list[str]
    group: str | None
    counted: DataFrame
    summary: dict[tuple, tuple[int, int, int]]

    def modes(self, wanted: set[tuple] | None = None) -> dict[tuple, str]:
        """(part, column) -> mode, of all or of the ``wanted`` ones; ties give the smallest."""
        spark = self.df.sparkSession
        slots = {name: slot for slot, name in enumerate(self.columns)}
        pending = {
            (part, slots[name]): most
            for (part, name), (_, _, most) in self.summary.items()
            if wanted is None or (part, name) in wanted
        }
        if not pending:
            return {}
        # A few numbers per part and column.
        asked = small_table(
            spark,
            [(part, slot, most) for (part, slot), most in pending.items()],
            "part int; slot int; cells long",
        )
        frequent = self.counted.join(F.broadcast(asked), ["part", "slot", "cells"], "left_semi")
        first = frequent.groupBy("part", "slot").agg(F.min("prefix").alias("prefix"))
        first = small_table(spark, first.collect(), "part int; slot int; prefix string")
        narrowed = frequent.join(F.broadcast(first), ["part", "slot", "prefix"], "left_semi")
        bitmap = settle(bitmap_of(narrowed, "h1"), "modes")
        cells = _hashed(_long_form(self.df, self.columns, self.group))
        passing = mark_members(
            cells.join(F.broadcast(first), ["part", "slot", "prefix"], "left_semi"), "h1", bitmap, "passes"
        ).where("passes")
        found: dict[tuple, str] = {}
        beyond: dict[tuple, str] = {}
        while pending:
            limits = small_table(
                spark,
                [(part, slot, beyond.get((part, slot))) for part, slot in pending],
                "part int; slot int; last string",
            )
            rest = passing.join(F.broadcast(limits), ["part", "slot"]).where("last IS NULL OR value > last")
            least = rest.groupBy("part", "slot").agg(F.min("value").alias("value"))
            # One text per part and column; most are right at once.
            rows = least.collect()
            if len(rows) < len(pending):
                raise RuntimeError("the table changed while its values were counted")
            least = small_table(spark, rows, "part int; slot int; value string")
            keys = ["part", "slot", "h1", "h2"]
            told = self.counted.join(F.broadcast(_hashed(least).drop("prefix")), keys)
            for row in told.select("part", "slot", "value", "cells").collect():
                place = row.part, row.slot
                if row.cells == pending[place]:
                    found[row.part, self.columns[row.slot]] = row.value
                    del pending[place]
                else:
                    beyond[place] = row.value
        return found


def count_values(df: DataFrame, columns: list[str], group: str | None = None) -> ValueCounts:
    """The counting pass; ``group`` names a column of small whole numbers.  A value held by a third of all rows is one row per task before the
    shuffle, and no group is ever larger than that."""
    counted = (
        _hashed(_long_form(df, columns, group))
        .groupBy("part", "slot", "prefix", "h1", "h2")
        .agg(F.count("*").alias("cells"))
    )
    counted = settle(counted, "values")
    summary = {
        (row.part, columns[row.slot]): (row.non_null, row.distinct_values, row.most)
        for row in counted.groupBy("part", "slot")
        .agg(F.sum("cells").alias("non_null"), F.count("*").alias("distinct_values"), F.max("cells").alias("most"))
        .collect()
    }
    return ValueCounts(df, columns, group, counted, summary)


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, non_null, distinct_values, mode, mode_cells); ties give the smallest value.
    Columns without a value have no row."""
    counts = count_values(df, columns)
    mode = counts.modes()
    rows = [
        (name, non_null, distinct, mode[0, name], most)
        for (_, name), (non_null, distinct, most) in counts.summary.items()
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, non_null long, distinct_values long, mode string, mode_cells long"
    )
