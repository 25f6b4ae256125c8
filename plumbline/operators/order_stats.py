"""Exact quantiles and order statistics of many columns at once.

The built-in ``percentile`` holds every distinct value in one buffer, so the search runs in
passes that shuffle only bucket counts, at every size: a mergeable sketch proposes a narrow interval around each wanted rank, a counting pass splits that
interval into buckets with their exact count, minimum and maximum, and the bucket holding
the rank becomes the next interval.  A wrong proposal costs one more pass, never a wrong
answer, because ranks are always taken from exact counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.limits import DEFAULT_LIMITS, Limits

_LARGEST = 1.7976931348623157e308
# Rows sketched, and the sketch's size.  Together they place a quantile within a third of a
# percent; the margin is three times that.
_SKETCHED_ROWS = 200_000
_SKETCH_SIZE = 1_000
_SKETCH_MARGIN = 0.01
_MERGE_FANOUT = 256
_STRIDE = 1 << 20
# Columns handled by one scan of the input; Parquet reads each column once either way, and
# small groups keep the generated code within what the JVM compiles.
_COLUMNS_PER_SCAN = 4


@dataclass
class _Interval:
    low: float
    high: float
    parts: int
    below: int | None = None  # rows under this interval, None while not yet counted
    ranks: set[int] = field(default_factory=set)


def finite(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(_LARGEST)), F.lit(-_LARGEST))


def whole(value: float) -> float:
    """Back from the largest finite numbers, which stand for the infinities in the search."""
    return value if abs(value) < _LARGEST else math.copysign(math.inf, value)


def _bucket(value: Column, intervals: list[_Interval]) -> Column:
    """Monotone bucket number, NULL outside all intervals."""
    branches = []
    for place, interval in enumerate(intervals):
        start = place * _STRIDE
        if interval.parts == 1 or interval.low == interval.high:
            number = F.lit(start)
        else:
            # Halved operands: the width of the whole double range would overflow.
            share = (value * 0.5 - interval.low * 0.5) / (interval.high * 0.5 - interval.low * 0.5)
            inner = F.floor(share * float(interval.parts)).cast("int")
            number = F.lit(start) + F.least(inner, F.lit(interval.parts - 1))
        inside = (value >= interval.low) & (value <= interval.high)
        branches.append(F.when(inside, number))
    return F.coalesce(*branches)


def _count_pass(
    df: DataFrame, values: dict[str, Column], intervals: dict[str, list[_Interval]]
) -> dict[str, list[tuple]]:
    """Count, minimum and maximum per bucket; the result is bounded by the bucket number."""
    names = list(intervals)
    groups = [names[i : i + _COLUMNS_PER_SCAN] for i in range(0, len(names), _COLUMNS_PER_SCAN)]
    slots = {name: slot for slot, name in enumerate(names)}

    def scan(group: list[str]) -> DataFrame:
        plain = df.select(*[finite(values[name]).alias(f"v{slots[name]}") for name in group])
        numbered = plain.select(
            "*",
            *[_bucket(F.col(f"v{slots[n]}"), intervals[n]).alias(f"b{slots[n]}") for n in group],
        )
        cells = numbered.select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(slots[name]).alias("slot"),
                            F.col(f"b{slots[name]}").alias("bucket"),
                            F.col(f"v{slots[name]}").alias("value"),
                        )
                        for name in group
                    ]
                )
            )
        )
        return (
            cells.where(F.col("bucket").isNotNull())
            .groupBy("slot", "bucket")
            .agg(F.count("*").alias("cells"), F.min("value").alias("low"), F.max("value").alias("high"))
        )

    counted = reduce(DataFrame.unionAll, [scan(group) for group in groups])
    table = counted.toPandas().sort_values(["slot", "bucket"])
    found: dict[str, list[tuple]] = {name: [] for name in names}
    for row in table.itertuples(index=False):
        found[names[row.slot]].append((int(row.bucket), int(row.cells), row.low, row.high))
    return found


def _proposals(
    df: DataFrame,
    values: dict[str, Column],
    ranks: dict[str, set[int]],
    counts: dict[str, int],
    buckets: int,
) -> dict[str, list[_Interval]]:
    """Intervals over the whole number line, narrow around the wanted ranks.

    They come from sketches of a sample, merged in two levels.  That only steers the search:
    the counting passes read every row."""
    names = list(ranks)
    fraction = min(1.0, _SKETCHED_ROWS / max(counts[name] for name in names))
    sample = df.select(*[finite(values[name]).alias(f"v{i}") for i, name in enumerate(names)])
    if fraction < 1.0:
        sample = sample.sample(fraction, seed=0)
    partial = sample.groupBy((F.spark_partition_id() % _MERGE_FANOUT).alias("part")).agg(
        *[
            F.kll_sketch_agg_double(f"v{i}", F.lit(_SKETCH_SIZE)).alias(f"s{i}")
            for i in range(len(names))
        ]
    )
    merged = partial.agg(
        *[F.kll_merge_agg_double(f"s{i}").alias(f"s{i}") for i in range(len(names))]
    )
    shares: dict[str, list[float]] = {}
    for name in names:
        edges = set()
        for rank in ranks[name]:
            share = rank / max(counts[name] - 1, 1)
            edges |= {max(share - _SKETCH_MARGIN, 0.0), min(share + _SKETCH_MARGIN, 1.0)}
        shares[name] = sorted(edges)
    found = merged.select(
        *[
            F.when(
                F.kll_sketch_get_n_double(f"s{i}") > 0,
                F.kll_sketch_get_quantile_double(
                    f"s{i}", F.array(*[F.lit(share) for share in shares[name]])
                ),
            ).alias(f"e{i}")
            for i, name in enumerate(names)
        ]
    ).first()
    proposed: dict[str, list[_Interval]] = {}
    for i, name in enumerate(names):
        # A column too sparse for the sample starts with its count and extremes alone.
        edges = found[i] or []
        last = max(counts[name] - 1, 1)
        pieces = []
        for place, (low, high) in enumerate(zip([-_LARGEST, *edges], [*edges, _LARGEST])):
            near = 0 < place < len(edges) and any(
                shares[name][place - 1] <= rank / last <= shares[name][place]
                for rank in ranks[name]
            )
            # The stretches between the wanted ranks are only counted.
            if low < high:
                pieces.append(_Interval(low, high, buckets if near else 1))
        proposed[name] = pieces
    return proposed


def _even_proposals(
    ranks: dict[str, set[int]], counts: dict[str, int], end: float, buckets: int
) -> dict[str, list[_Interval]]:
    """The same for values spread evenly over [0, end), whose ranks are nearly known."""
    proposed = {}
    for name, wanted in ranks.items():
        size = counts[name]
        shares = [(rank + 0.5) / size for rank in wanted]
        edges = {0.0, 1.0}
        for share in shares:
            # Six standard deviations of a binomial count to each side.
            margin = 6.0 * math.sqrt(share * (1.0 - share) / size) + 1.0 / size
            edges |= {max(share - margin, 0.0), min(share + margin, 1.0)}
        bounds = sorted(edges)
        proposed[name] = [
            _Interval(
                low * end,
                high * end,
                buckets if any(low <= share <= high for share in shares) else 1,
            )
            for low, high in zip(bounds, bounds[1:])
        ]
    return proposed


def order_statistics(
    df: DataFrame,
    values: dict[str, Column],
    ranks: dict[str, set[int]],
    counts: dict[str, int],
    even_up_to: float | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> dict[tuple[str, int], tuple[float, int | None]]:
    """For each column and zero-based rank: the value, and how many values do not exceed it.

    The latter is None where the search ended without it.  ``counts`` are the non-null values
    per column.  ``even_up_to`` says that values are spread evenly over [0, even_up_to) and
    saves the sketch; it also makes the search go on until that number is known."""
    ranks = {name: set(wanted) for name, wanted in ranks.items() if wanted}
    if not ranks:
        return {}
    if even_up_to is None:
        intervals = _proposals(df, values, ranks, counts, limits.buckets)
    else:
        intervals = _even_proposals(ranks, counts, even_up_to, limits.buckets)
    found: dict[tuple[str, int], tuple[float, int | None]] = {}
    while intervals:
        counted = _count_pass(df, values, intervals)
        following: dict[str, list[_Interval]] = {}
        for name, searched in intervals.items():
            below = 0
            for bucket, cells, low, high in counted[name]:
                interval = searched[bucket // _STRIDE]
                if interval.below is not None and bucket % _STRIDE == 0:
                    below = interval.below
                wanted = ranks[name] if interval.below is None else interval.ranks
                pending = set()
                for rank in wanted:
                    if not below <= rank < below + cells:
                        continue
                    if low == high or rank == below + cells - 1:
                        found[name, rank] = (high, below + cells)
                    elif rank == below and even_up_to is None:
                        found[name, rank] = (low, None)
                    else:
                        pending.add(rank)
                if pending:
                    following.setdefault(name, []).append(
                        _Interval(low, high, limits.buckets, below, pending)
                    )
                below += cells
        intervals = following
    return found


def quantiles(
    df: DataFrame,
    values: dict[str, Column],
    counts: dict[str, int],
    shares: tuple[float, ...],
    limits: Limits = DEFAULT_LIMITS,
) -> dict[str, tuple[float, ...]]:
    """Linearly interpolated quantiles of every column that has values."""
    names = [name for name in values if counts[name] > 0]
    if not names:
        return {}
    ranks = {}
    for name in names:
        places = [(counts[name] - 1) * share for share in shares]
        ranks[name] = {rank for p in places for rank in (math.floor(p), math.ceil(p))}
    found = order_statistics(df, values, ranks, counts, limits=limits)
    result = {}
    for name in names:
        result[name] = tuple(
            interpolated(counts[name], share, lambda rank: whole(found[name, rank][0])) for share in shares
        )
    return result


def interpolated(count: int, share: float, value_at: Callable[[int], float]) -> float:
    """The quantile between the values of the two ranks next to it."""
    place = (count - 1) * share
    low, high = math.floor(place), math.ceil(place)
    if low == high:
        return value_at(low)
    return (high - place) * value_at(low) + (place - low) * value_at(high)
