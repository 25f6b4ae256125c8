"""Decimal rounding that looks at the exact binary value of a double.

``round`` in SQL engines first multiplies (or prints) the value and so rounds a result that
is already rounded: 2.675 is below the tie as a double, yet becomes 2.68.  Here the product's
rounding error is recovered by splitting the double in halves, which decides the ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = float(2**27 + 1)
_EXACT_LIMIT = float(2**52)


def round_exact(value: Column, digits: int, ties: str = "even") -> Column:
    """Round to ``digits`` decimals; exact ties go to the even neighbour, or up."""
    scale = float(10**digits)
    value = value.cast("double")
    scaled = value * scale
    spread = value * _SPLIT
    high = spread - (spread - value)
    residue = (high * scale - scaled) + (value - high) * scale
    whole = F.floor(scaled).cast("double")
    beyond = scaled - (whole + 0.5)
    on_tie = F.pmod(whole, F.lit(2.0)) == 1.0 if ties == "even" else F.lit(True)
    up = (beyond > 0) | ((beyond == 0) & ((residue > 0) | ((residue == 0) & on_tie)))
    rounded = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(F.abs(scaled) < _EXACT_LIMIT, rounded).otherwise(value)


def percentage(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent with two digits, 0.0 of nothing."""
    ratio = F.try_divide(part.cast("double"), whole.cast("double")) * 100.0
    return F.coalesce(round_exact(ratio, 2), F.lit(0.0))
