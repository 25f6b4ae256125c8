"""Choosing columns by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def identifier(name: str) -> str:
    """The column in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(identifier(name))


def data_fields(df: DataFrame, key: str | None = None) -> list[T.StructField]:
    """Every field but the row key, which takes no part in metrics or cleaning."""
    return [field for field in df.schema.fields if field.name != key]


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType))


def is_categorical(field: T.StructField) -> bool:
    """Filled by mode or placeholder: text, boolean and calendar columns."""
    return is_text(field) or isinstance(
        field.dataType, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    )


def is_ordered(field: T.StructField) -> bool:
    """Whether Spark can compare and group the values: not if a map or variant is inside."""

    def ordered(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return ordered(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(ordered(part.dataType) for part in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return ordered(field.dataType)


def numeric_value(field: T.StructField) -> Column:
    return quoted(field.name).cast("double")
