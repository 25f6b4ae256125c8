"""Delimited files whose cells hold line breaks, parsed by many tasks (SRC1).

Spark gives such a file to one task.  Here tasks read ranges of it as lines.  A line begins a record
if an even number of quotes lies before it in the file, so the quotes of each range are counted
first and added up in the order of ranges; then each task knows how its range begins and puts
lines together to records.  A record that goes beyond its range is left in pieces, at most two a
range, which are joined afterwards.  Records are parsed by Spark's own parser and written once as
Parquet, so that later passes read their columns and parse nothing again.

Quotes must be well-formed: a cell with quotes or line breaks is quoted, quotes in it are doubled.
Line breaks in cells stay as they are, CRLF too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.storage import settle

# Kinds of what a range yields: a record, the first pieces of one, and what continues one.
_RECORD, _OPEN, _MORE = 0, 1, 2


class _Range:
    """Puts the lines of one range together; lines come in order, in parts."""

    def __init__(self, file: str, start: int, odd: bool):
        self.place, self.odd = (file, start), odd
        self.header = start == 0
        # Lines of the record at hand; a range may begin inside one.
        self.lines: list[str] = []
        self.more = odd
        self.out: list[tuple] = []

    def _close(self, ended: bool) -> None:
        if not self.lines:
            return
        text = "\n".join(self.lines)
        if ended:
            text = text.removesuffix("\r")
        if self.more or not ended:
            # Whether more follows is told by the kind of what comes next.
            self.out.append((*self.place, _MORE if self.more else _OPEN, text))
        elif self.header:
            self.header = False
        elif text.strip():
            self.out.append((*self.place, _RECORD, text))
        self.lines, self.more = [], False

    def read(self, lines: pa.Array) -> None:
        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
        before = (int(self.odd) + np.cumsum(quotes) - quotes) % 2
        for line, inside in zip(lines.to_pylist(), before.tolist()):
            if not inside:
                self._close(True)
            self.lines.append(line)
        self.odd = bool((int(before[-1]) + int(quotes[-1])) % 2)

    def end(self) -> list[tuple]:
        self._close(not self.odd)
        return self.out


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "start", "kind", "text"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    at = None
    for batch in batches:
        file, start = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        codes = file.indices.to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (start[1:] != start[:-1])]))
        for first, stop in zip(cut.tolist(), [*cut[1:].tolist(), batch.num_rows]):
            place = batch.column(1)[first].as_py(), int(start[first])
            if at is None or at.place != place:
                if at is not None and (rows := at.end()):
                    yield batch_of(rows)
                at = _Range(*place, batch.column(3)[first].as_py())
            at.read(batch.column(0).slice(first, stop - first))
            if at.out:
                yield batch_of(at.out)
                at.out = []
    if at is not None and (rows := at.end()):
        yield batch_of(rows)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``start`` of the range, ``kind`` and ``text`` of records and pieces of records, but
    for each file's first record; blank lines are none."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)) == 1
    # One row per range of the files.
    ranges = settle(counted.select("file", "start", odd.alias("odd")), "ranges")
    placed = lines.join(F.broadcast(ranges), ["file", "start"]).select("value", "file", "start", "odd")
    return placed.mapInArrow(_assemble, "file string, start long, kind int, text string")


def read_quoted_csv(spark: SparkSession, path: str, names: list[str], separator: str = ",") -> DataFrame:
    """All columns as text, for files whose first records hold the ``names``."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": "true"}
    ddl = ", ".join(f"{f.name} string" for f in schema.fields)

    def parsed(text):
        return F.from_csv(text, ddl, options)

    made = csv_records(spark, path)
    stored = settle(
        made.select(
            "file", "start", "kind", F.when(F.col("kind") != _RECORD, F.col("text")).alias("text"),
            F.when(F.col("kind") == _RECORD, parsed(F.col("text"))).alias("row"),
        ),
        "csv",
    )
    pieces = stored.where(F.col("kind") != _RECORD)
    # What continues a record comes first in its range, what opens one last.
    order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    numbered = pieces.withColumn("record", F.sum((F.col("kind") == _OPEN).cast("int")).over(order))
    joined = numbered.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts")
    )
    whole = F.array_join(F.transform("parts", lambda part: part["text"]), "\n")
    rows = stored.where(F.col("kind") == _RECORD).select("row").unionAll(joined.select(parsed(whole).alias("row")))
    return rows.select(*[F.col("row")[f.name].alias(name) for f, name in zip(schema.fields, names)])
