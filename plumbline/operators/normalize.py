"""PRJ1: one spelling for a missing cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import data_fields, is_text, quoted
from plumbline.functions.tokens import is_missing_token


def _normalized(field: T.StructField) -> Column:
    value = quoted(field.name)
    if is_text(field):
        return F.when(~is_missing_token(value), value).alias(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value).alias(field.name)
    if isinstance(field.dataType, T.CalendarIntervalType):
        return value.cast("string").alias(field.name)
    if isinstance(field.dataType, T.NullType):
        return F.lit(None).cast("double").alias(field.name)
    return value.alias(field.name)


def normalize_missing(df: DataFrame, key: str | None = None) -> DataFrame:
    """Marker words in text columns and NaN in float columns become NULL; types stay, but
    for intervals of mixed units, which cannot be compared or stored and become text."""
    changed = {field.name: _normalized(field) for field in data_fields(df, key)}
    return df.select(*[changed.get(name, quoted(name)) for name in df.columns])
