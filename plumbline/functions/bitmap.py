"""A set of 64-bit digests as a bitmap of fixed size.

The bitmap may hold digests that were never put in, but none that was put in is missing.  It lets
the rows pass that need an exact look, and its size does not depend on how many there are: rows of
64 bits, at most ``2 ** BITS / 64`` of them, small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24
_WORD, _SET = "__word", "__bits"


def _place(digest: Column) -> Column:
    """Low digits of a digest; the digests are hashes already."""
    return digest.bitwiseAND(F.lit((1 << BITS) - 1))


def bitmap_of(digests: DataFrame, column: str) -> DataFrame:
    """The words of the bitmap that have a bit, one row each."""
    place = _place(F.col(column))
    bit = F.expr(f"shiftleft(1L, cast(`{column}` & 63 AS int))")
    return digests.select(F.shiftright(place, 6).alias(_WORD), bit.alias(_SET)).groupBy(_WORD).agg(F.bit_or(_SET).alias(_SET))


def mark_members(df: DataFrame, digest: str, bitmap: DataFrame, name: str) -> DataFrame:
    """``df`` with the flag ``name``: whether the bitmap has the row's digest."""
    marked = df.withColumn(_WORD, F.shiftright(_place(F.col(digest)), 6))
    marked = marked.join(F.broadcast(bitmap), _WORD, "left")
    bit = F.expr(f"(shiftright({_SET}, cast(`{digest}` & 63 AS int)) & 1) = 1")
    return marked.withColumn(name, F.coalesce(bit, F.lit(False))).drop(_WORD, _SET)
