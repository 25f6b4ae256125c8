"""Numbers and flags as they appear in reports and views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.rounding import round_exact


def flag_text(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")


def fixed(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", round_exact(value, digits))


def signed(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%+.{digits}f", round_exact(value, digits))


def one_decimal(value: Column) -> Column:
    """Nearest tenth, halves upwards."""
    return round_exact(value, 1, ties="up")


def percent_text(value: Column) -> Column:
    """VIEW10: ``12.3%``; nothing reads as zero."""
    shown = one_decimal(F.coalesce(value.cast("double"), F.lit(0.0)))
    return F.concat(F.format_string("%.1f", shown), F.lit("%"))


def delta_text(before: Column, after: Column) -> Column:
    """VIEW10: change in percent points, with a plus sign when it grew."""
    change = F.coalesce(after.cast("double"), F.lit(0.0)) - F.coalesce(
        before.cast("double"), F.lit(0.0)
    )
    shown = one_decimal(change)
    sign = F.when(shown > 0, "+").otherwise("")
    # Adding 0.0 turns a negative zero into a plain one.
    return F.concat(sign, F.format_string("%.1f", shown + F.lit(0.0)), F.lit("%"))


def grouped_digits(value: Column) -> Column:
    """An integer with thousands separators."""
    return F.format_number(value.cast("long"), 0)


def file_stem(path: Column) -> Column:
    """Last path element without its last suffix; a leading dot starts no suffix."""
    name = F.regexp_replace(path, r"^.*/", "")
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")
