"""Seeded sampling without replacement of an exact number of cells or rows (EVA1).

Cells are ordered by a hash of row key, column and seed; the sample is the first k.  The
k-th hash is found by the bucket search of ``order_stats``, so no column is ever sorted in
one task, and the sample is then a plain filter.

A row is digested once.  Each column scrambles the two numbers taken from the digest with a
factor of its own, so that columns are sampled independently at the price of a product.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.limits import DEFAULT_LIMITS, Limits
from plumbline.operators.order_stats import order_statistics

# Hex digits taken from digests.  Hashes have 52 bits, which a double holds exactly.  The
# product of a row's second number with a column's factor has 60, so that it runs many times
# through all hashes and still fits a long.
_BASE_DIGITS = 13
_MIX_DIGITS = 6
_FACTOR_DIGITS = 9
_HASH_END = 16**_BASE_DIGITS

_BASE, _MIX = "__hash_base", "__hash_mix"


def with_row_hash(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds the numbers that `cell_hash` reads."""
    digest = F.md5(F.concat(quoted(key).cast("string"), F.lit(f"|{seed}")))
    digested = df.withColumn(_BASE, digest)

    def number(start: int, digits: int) -> Column:
        return F.conv(F.substring(F.col(_BASE), start, digits), 16, 10).cast("bigint")

    return digested.withColumns(
        {_MIX: number(_BASE_DIGITS + 1, _MIX_DIGITS), _BASE: number(1, _BASE_DIGITS)}
    )


def column_factor(label: str, seed: int) -> int:
    digest = hashlib.md5(f"{label}|{seed}".encode()).hexdigest()
    return int(digest[:_FACTOR_DIGITS], 16)


def cell_hash(label: str, seed: int) -> Column:
    """Evenly spread number for one row's cell, the same in every run and engine."""
    mixed = F.col(_MIX) * F.lit(column_factor(label, seed)) + F.col(_BASE)
    return F.pmod(mixed, F.lit(_HASH_END)).cast("double")


@dataclass(frozen=True)
class Cut:
    """The sampled cells: hash below ``threshold``, or at it with a key up to ``last_key``."""

    threshold: float
    last_key: object | None

    def chosen(self, key: str, label: str, seed: int) -> Column:
        """Filter for a table with row hashes."""
        hashed = cell_hash(label, seed)
        at = hashed == self.threshold
        if self.last_key is not None:
            at = at & (quoted(key) <= F.lit(self.last_key))
        return (hashed < self.threshold) | at


def fit_cuts(
    df: DataFrame,
    key: str,
    eligible: dict[str, Column],
    counts: dict[str, int],
    sizes: dict[str, int],
    seed: int,
    limits: Limits = DEFAULT_LIMITS,
) -> dict[str, Cut]:
    """For each label, the cut that keeps ``sizes[label]`` of its ``counts[label]`` eligible
    rows."""
    labels = [label for label in eligible if sizes[label] > 0]
    if not labels:
        return {}
    df = with_row_hash(df, key, seed)
    hashed = {label: F.when(eligible[label], cell_hash(label, seed)) for label in labels}
    ranks = {label: {sizes[label] - 1} for label in labels}
    found = order_statistics(df, hashed, ranks, counts, even_up_to=float(_HASH_END), limits=limits)
    cuts = {}
    for label in labels:
        threshold, reached = found[label, sizes[label] - 1]
        last_key = None
        surplus = reached - sizes[label]
        if surplus:
            # Of the rows with an equal hash, a handful, those with the largest keys go.
            tied = df.where(hashed[label] == threshold).select(quoted(key).alias("key"))
            largest = tied.orderBy(F.desc("key")).limit(surplus + 1)
            last_key = largest.agg(F.min("key")).first()[0]
        cuts[label] = Cut(threshold, last_key)
    return cuts
