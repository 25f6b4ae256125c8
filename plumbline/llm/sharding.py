"""Sharding by histogram sort.

Rows are ordered by a hash of their text, then by id, so that equal texts stand together.  The
splitters between shards are found by counting, not by sampling: each pass over a narrow key
table counts the exact bytes and rows below a few hundred probe keys, and the next probes
subdivide the brackets around the targets, until every splitter is within tolerance.  A splitter
falls between two different texts where the tolerance allows it.  Then rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.storage import settle

SHARDS = 16
# A splitter may miss its target by this share of a shard's bytes.
TOLERANCE = 0.002
_FIRST_PROBES = 1024
_PROBES = 48
# A shard is exchanged as several ranges of about so many bytes, whose rows are numbered apart.
_RANGE_BYTES = 64 << 20
_RANGES = (4, 64)
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1

# Hash of the text, id, and a row number where rows are equal in both.
Key = tuple[int, int, int]


@dataclass(frozen=True)
class Splitters:
    """For each shard the keys that open its ranges, each with the number of rows before it; and
    whether rows equal in all of a key kept a splitter from its target."""

    shards: list[list[tuple[Key, int]]]
    missed: bool


@dataclass(frozen=True)
class _Cell:
    """What lies from one probe to the next: bytes and rows before it, and its extreme keys."""

    bytes: int
    rows: int
    low: Key
    high: Key


def _count_cells(keys: DataFrame, probes: list[Key]) -> list[_Cell]:
    """A pass over all keys.  Cell ``i`` starts at probe ``i``; the first probe is below all."""
    sorted_probes = [np.array([p[side] for p in probes], np.int64) for side in range(3)]
    n = len(probes)

    def run(batches):
        sums = np.zeros((n, 2), np.int64)
        low = np.full((n, 3), _HIGHEST, np.int64)
        high = np.full((n, 3), _LOWEST, np.int64)
        for batch in batches:
            *keys, size = [batch.column(i).to_numpy() for i in range(4)]
            # Probes and rows sorted together; a probe stands before the row that equals it.
            is_row = np.r_[np.zeros(n, np.int8), np.ones(len(size), np.int8)]
            both = [np.r_[probe, key] for probe, key in zip(sorted_probes, keys)]
            order = np.lexsort((is_row, *both[::-1]))
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(is_row[order] == 0) - 1
            place = place[n:]
            np.add.at(sums[:, 0], place, size)
            np.add.at(sums[:, 1], place, 1)
            for side, values in enumerate(keys):
                np.minimum.at(low[:, side], place, values)
                np.maximum.at(high[:, side], place, values)
        seen = np.flatnonzero(sums[:, 1])
        columns = [seen, *sums[seen].T, *low[seen].T, *high[seen].T]
        yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in columns], _CELL.replace(" long", "").split(", "))

    sums = [F.sum(c).alias(c) for c in ("bytes", "rows")]
    lows = [F.min(f"low_{c}").alias(f"low_{c}") for c in _PARTS]
    highs = [F.max(f"high_{c}").alias(f"high_{c}") for c in _PARTS]
    counted = keys.mapInArrow(run, _CELL).groupBy("place").agg(*sums, *lows, *highs)
    found = {row["place"]: row for row in counted.collect()}
    cells, size, rows = [], 0, 0
    for i, probe in enumerate(probes):
        row = found.get(i)
        extremes = [tuple(row[f"{end}_{c}"] for c in _PARTS) for end in ("low", "high")] if row else (probe, probe)
        cells.append(_Cell(size, rows, *extremes))
        size, rows = size + (row["bytes"] if row else 0), rows + (row["rows"] if row else 0)
    return cells


_PARTS = ("key", "tie", "row")
_CELL = "place long, bytes long, rows long, " + ", ".join(f"{end}_{c} long" for end in ("low", "high") for c in _PARTS)


def _spread(low: int, high: int, parts: int) -> list[int]:
    """Up to ``parts`` numbers above ``low``, evenly to ``high``."""
    return sorted({low + -(-(high - low) * i // parts) for i in range(1, parts + 1)} - {low})


def find_splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> Splitters:
    """Splitters over a table of ``key``, ``tie``, ``row`` and ``size`` (whole numbers, none null)."""
    total, rows = keys.agg(F.sum("size"), F.count("*")).first()
    start: Key = (_LOWEST, _LOWEST, _LOWEST)
    if not rows:
        return Splitters([[(start, 0)]], False)
    allowed = tolerance * total / shards
    known: dict[Key, tuple[int, int]] = {start: (0, 0)}
    targets = {i: total * i // shards for i in range(1, shards)}
    chosen: dict[int, Key] = {}
    missed = False
    probes = [start, *((key, _LOWEST, _LOWEST) for key in _spread(_LOWEST, _HIGHEST, _FIRST_PROBES))]
    while targets:
        cells = _count_cells(keys, probes)
        known |= {probe: (cell.bytes, cell.rows) for probe, cell in zip(probes, cells)}
        below = [cell.bytes for cell in cells]
        following: set[Key] = set()
        for i, target in list(targets.items()):
            at = bisect_right(below, target) - 1
            ends = [(abs(below[j] - target), probes[j]) for j in (at, at + 1) if j < len(probes)]
            low, high = cells[at].low, cells[at].high
            more = [(key, _LOWEST, _LOWEST) for key in _spread(low[0], high[0], _PROBES)]
            if not more:
                # One text alone holds the target: it is split by id, one id by row numbers.
                more = [(low[0], tie, _LOWEST) for tie in _spread(low[1], high[1], _PROBES)]
                more = more or [(low[0], low[1], row) for row in _spread(low[2], high[2], _PROBES)]
            if min(ends)[0] <= allowed or not more:
                after = cells[at + 1].rows if at + 1 < len(cells) else rows
                missed |= min(ends)[0] > allowed and after - cells[at].rows > 1
                chosen[i] = min(ends)[1]
                del targets[i]
            else:
                following |= {probes[at], *more, *(probes[at + 1 : at + 2])}
        probes = sorted({start, *following})
    opens = [start, *(chosen[i] for i in range(1, shards))]
    ordered = sorted(known, key=lambda key: (known[key], key))
    per_shard = min(max(_RANGES[0], -(-total // shards // _RANGE_BYTES)), _RANGES[1])
    result = []
    for shard, opening in enumerate(opens):
        closing = opens[shard + 1] if shard + 1 < shards else None
        ranges, wanted = [(opening, known[opening][1])], 1
        for key in ordered:
            if key > opening and (closing is None or key < closing):
                if known[key][0] >= total * shard // shards + total * wanted // shards // per_shard:
                    ranges.append((key, known[key][1]))
                    while known[key][0] >= total * shard // shards + total * wanted // shards // per_shard:
                        wanted += 1
        result.append(ranges)
    return Splitters(result, missed)


def _literal(keys: list[Key]) -> str:
    entries = [f"named_struct('a', bigint('{a}'), 'b', bigint('{b}'), 'c', bigint('{c}'))" for a, b, c in keys]
    return f"array({', '.join(entries)})"


_REACHED = "x -> x.a < __key or (x.a = __key and (x.b < __tie or (x.b = __tie and x.c <= __numbered)))"


def sort_key(text: Column) -> Column:
    return F.xxhash64(text)


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``docs`` with the columns ``size``, ``shard`` and ``slot`` (replaced where there).

    A row's size is the UTF-8 bytes of its text plus 1.  Shards have nearly equal bytes: each
    splitter is within ``tolerance`` of its target, or as near as whole rows allow.  Slots count
    from 0 without gaps.  Equal texts follow one another and share a shard unless a splitter has
    to fall among them.  A null text has size 1 and sorts with the empty ones; a null id sorts
    first; rows equal in both are ordered arbitrarily.  Where so many rows are equal in both that a
    splitter must fall among them, the table is written once with numbered rows."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    made = {
        "__key": sort_key(text),
        "__tie": F.coalesce(F.col(f"`{id_column}`").cast("long"), F.lit(_LOWEST)),
        "size": (F.octet_length(text) + 1).cast("long"),
    }
    names = [c for c in docs.columns if c not in ("size", "shard", "slot")]

    def search(df: DataFrame, row: Column) -> Splitters:
        parts = [made["__key"].alias("key"), made["__tie"].alias("tie"), row.alias("row"), made["size"].alias("size")]
        return find_splitters(settle(df.select(*parts), "keys"), shards, tolerance)

    made["__numbered"] = F.lit(0).cast("long")
    found = search(docs, made["__numbered"])
    if found.missed:
        docs = settle(docs.withColumn("__own_row", F.monotonically_increasing_id()), "numbered-rows")
        made["__numbered"] = F.col("__own_row")
        found = search(docs, made["__numbered"])
    splitters = found.shards
    keyed = docs.select(*[F.col(f"`{c}`") for c in names], *[c.alias(name) for name, c in made.items()])
    opens = _literal([ranges[0][0] for ranges in splitters])
    ranges = f"array({', '.join(_literal([key for key, _ in each]) for each in splitters)})"
    before = f"array({', '.join('array(' + ', '.join(f'{n - each[0][1]}L' for _, n in each) + ')' for each in splitters)})"
    placed = keyed.withColumn("shard", F.expr(f"greatest(size(filter({opens}, {_REACHED})) - 1, 0)")).withColumn(
        "__range", F.expr(f"greatest(size(filter(get({ranges}, shard), {_REACHED})) - 1, 0)")
    )
    order = Window.partitionBy("shard", "__range").orderBy("__key", "__tie", "__numbered")
    numbered = placed.withColumn("__row", F.row_number().over(order))
    slot = F.expr(f"get(get({before}, shard), __range) + __row - 1").cast("long")
    return numbered.select(*[F.col(f"`{c}`") for c in names], "size", "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder of files per shard, rows of a file in slot order."""
    shard(docs, **options).write.partitionBy("shard").parquet(path)


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 16 shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    )
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
