"""Quality metrics of one table (AGG1 to AGG9)."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    data_fields,
    identifier,
    is_numeric,
    is_ordered,
    is_text,
    quoted,
)
from plumbline.functions.rounding import percentage, round_exact
from plumbline.functions.tokens import is_number
from plumbline.limits import DEFAULT_LIMITS, Limits
from plumbline.operators.distinct import DuplicateSearch, find_duplicates
from plumbline.operators.normalize import normalize_missing
from plumbline.operators.order_stats import quantiles

_FENCE_FACTOR = 1.5
FENCE_MIN_VALUES = 4
_MIXED_MIN_VALUES = 5
_MIXED_RANGE = (0.10, 0.90)
# Columns measured by one scan.  Parquet reads each column once however they are grouped; the
# aggregation buffer of eight columns stays under the width at which Spark stops generating
# code.
COLUMNS_PER_SCAN = 8
# Sums of squared or cubed deviations below this count as zero when taking the skew.
_NO_SPREAD = 1e-14

QUALITY_FEATURES = (
    "missing_pct",
    "duplicate_pct",
    "outlier_pct",
    "type_inconsistency_pct",
    "null_col_ratio",
    "constant_col_ratio",
    "avg_skewness",
)

METRIC_COLUMNS = (
    "total_rows",
    "missing_count",
    "missing_pct",
    "duplicate_count",
    "duplicate_pct",
    "outlier_count",
    "outlier_pct",
    "type_inconsistency_pct",
    "null_col_ratio",
    "constant_col_ratio",
    "avg_skewness",
)


@dataclass(frozen=True)
class Fences:
    column: str
    non_null: int
    q1: float
    q3: float

    @property
    def usable(self) -> bool:
        return self.non_null >= FENCE_MIN_VALUES and self.q3 - self.q1 != 0

    @property
    def lower(self) -> float:
        return self.q1 - _FENCE_FACTOR * (self.q3 - self.q1)

    @property
    def upper(self) -> float:
        return self.q3 + _FENCE_FACTOR * (self.q3 - self.q1)


def total(columns: Iterable[Column]) -> Column:
    """Sum of columns, paired up so that wide tables give a shallow expression."""
    level = list(columns) or [F.lit(0).cast("long")]
    while len(level) > 1:
        level = [reduce(add, level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0]


def sample_skewness(name: str) -> Column:
    """Bias-corrected skewness of a numeric column; 0.0 for fewer than three values or no
    spread."""
    value = f"cast({identifier(name)} AS double)"
    n = f"cast(count({value}) AS double)"
    squares = f"var_pop({value}) * {n}"
    cubes = f"skewness({value}) * power({squares}, 1.5D) / sqrt({n})"
    return F.expr(
        f"""coalesce(
          CASE WHEN {n} >= 3 AND {squares} >= {_NO_SPREAD} AND abs({cubes}) >= {_NO_SPREAD}
                AND NOT isnan(skewness({value}))
               THEN skewness({value}) * sqrt({n} * ({n} - 1)) / ({n} - 2) END,
          0D)"""
    )


def column_statistics(
    table: DataFrame, key: str | None = None, group: str | None = None
) -> DataFrame:
    """One row per column, without a data shuffle; per value of the column ``group``, if one is
    named, which then takes no part itself.

    ``table`` is already normalized.  A column may be constant if it is all null, or has no
    nulls and equal extremes, which needs no distinct count.  Text is compared by digest so
    that the aggregation buffer has a fixed width; `constant_columns` settles those."""
    fields = list(enumerate(f for f in data_fields(table, key) if f.name != group))
    scans = [fields[i : i + COLUMNS_PER_SCAN] for i in range(0, len(fields), COLUMNS_PER_SCAN)]
    return reduce(DataFrame.unionAll, [_statistics_scan(table, scan, group) for scan in scans])


def _statistics_scan(
    table: DataFrame, fields: list[tuple[int, T.StructField]], group: str | None
) -> DataFrame:
    measures = [_measures(position, field).alias(f"m{position}") for position, field in fields]
    by = [quoted(group)] if group else []
    gathered = table.groupBy(*by).agg(*measures)
    return gathered.select(*by, F.inline(F.array(*[f"m{position}" for position, _ in fields])))


def _measures(position: int, field: T.StructField) -> Column:
    value = identifier(field.name)
    constant = f"count({value}) = 0"
    if is_ordered(field):
        seen = f"xxhash64({value})" if has_variable_width(field) else value
        constant += f" OR (count({value}) = count(*) AND min({seen}) = max({seen}))"
    nothing = F.lit(None).cast("double")
    text_measure = F.avg(is_number(quoted(field.name)).cast("double"))
    return F.struct(
        F.lit(position).alias("position"),
        F.lit(field.name).alias("column"),
        F.lit(field.dataType.simpleString()).alias("data_type"),
        F.expr("count(*)").alias("total_rows"),
        F.expr(f"count(*) - count({value})").alias("null_count"),
        F.expr(f"coalesce({constant}, false)").alias("may_be_constant"),
        (text_measure if is_text(field) else nothing).alias("numeric_ratio"),
        (sample_skewness(field.name) if is_numeric(field) else nothing).alias("skewness"),
    )


def has_variable_width(field: T.StructField) -> bool:
    return isinstance(
        field.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.DecimalType)
    )


def constant_columns(table: DataFrame, statistics: list) -> set[str]:
    """AGG8: names of columns with one value, null counting as a value.

    Different digests prove different values.  Equal ones do not prove equal values, so the
    few columns left are compared by value."""
    types = {field.name: field for field in table.schema.fields}
    likely = [row.column for row in statistics if row.may_be_constant]
    doubtful = [
        row.column
        for row in statistics
        if row.may_be_constant and row.null_count == 0 and has_variable_width(types[row.column])
    ]
    if not doubtful:
        return set(likely)
    equal = table.agg(
        *[F.min(quoted(name)) == F.max(quoted(name)) for name in doubtful]
    ).first()
    differing = {name for name, same in zip(doubtful, equal) if not same}
    return set(likely) - differing


def is_mixed(numeric_ratio: Column, non_null: Column) -> Column:
    """AGG6 on one text column: some but not most of its values read as numbers."""
    low, high = _MIXED_RANGE
    return F.coalesce(
        (non_null >= _MIXED_MIN_VALUES) & (numeric_ratio > low) & (numeric_ratio < high),
        F.lit(False),
    )


def is_mixed_column(statistics) -> bool:
    """AGG6 on a row of ``column_statistics``."""
    low, high = _MIXED_RANGE
    return (
        statistics.numeric_ratio is not None
        and statistics.total_rows - statistics.null_count >= _MIXED_MIN_VALUES
        and low < statistics.numeric_ratio < high
    )


def fit_fences(
    table: DataFrame, non_null: dict[str, int], limits: Limits = DEFAULT_LIMITS
) -> list[Fences]:
    """AGG3: quartile fences of the given numeric columns."""
    values = {name: quoted(name).cast("double") for name in non_null}
    enough = {name: n for name, n in non_null.items() if n >= FENCE_MIN_VALUES}
    found = quantiles(table, {name: values[name] for name in enough}, enough, (0.25, 0.75), limits)
    return [Fences(name, non_null[name], *found[name]) for name in enough]


def below(fences: Fences) -> Column:
    """Under the lower fence.  Where infinite quartiles leave no fence nothing is outside: Spark
    orders NaN above all numbers, but no number is compared with it here."""
    if math.isnan(fences.lower):
        return F.lit(False)
    return quoted(fences.column).cast("double") < fences.lower


def above(fences: Fences) -> Column:
    if math.isnan(fences.upper):
        return F.lit(False)
    return quoted(fences.column).cast("double") > fences.upper


def outside(fences: Fences) -> Column:
    return below(fences) | above(fences)


@dataclass(frozen=True)
class TableProfile:
    """Driver-side state of a few numbers per column, which shapes the later passes."""

    table: DataFrame
    key: str | None
    rows: int
    columns: list
    fences: list[Fences]
    constant: set[str]
    duplicates: DuplicateSearch

    @property
    def nulls(self) -> dict[str, int]:
        return {column.column: column.null_count for column in self.columns}


def numeric_names(table: DataFrame, key: str | None = None) -> list[str]:
    return [field.name for field in data_fields(table, key) if is_numeric(field)]


def fit_profile(
    table: DataFrame,
    key: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
    distinct: int | None = None,
) -> TableProfile:
    """Column statistics, fences and shared row digests of a normalized table, whose number
    of ``distinct`` rows may be known already."""
    columns = sorted(column_statistics(table, key).collect(), key=lambda row: row.position)
    rows = columns[0].total_rows
    numeric = set(numeric_names(table, key))
    non_null = {c.column: rows - c.null_count for c in columns if c.column in numeric}
    if distinct is None:
        duplicates = find_duplicates(table, rows, key, limits)
    else:
        duplicates = DuplicateSearch(table, rows, key, distinct=distinct)
    return TableProfile(
        table,
        key,
        rows,
        columns,
        fit_fences(table, non_null, limits),
        constant_columns(table, columns),
        duplicates,
    )


def require_rows(df: DataFrame) -> None:
    """SRC3: a table without rows or columns is an error."""
    if not df.columns or df.isEmpty():
        raise ValueError("the table is empty")


def missing_summary(table: DataFrame, key: str | None = None) -> DataFrame:
    """AGG1, AGG7: missing cells of a normalized table and columns that have any."""
    fields = data_fields(table, key)
    counted = table.agg(
        F.count("*").alias("total_rows"),
        F.array(*[F.count_if(quoted(f.name).isNull()) for f in fields]).alias("nulls"),
    ).select(
        "total_rows",
        F.aggregate("nulls", F.lit(0).cast("long"), lambda acc, n: acc + n).alias("missing_count"),
        F.size(F.filter("nulls", lambda n: n > 0)).cast("long").alias("null_columns"),
    )
    width = F.lit(len(fields))
    return counted.select(
        "total_rows",
        "missing_count",
        percentage(F.col("missing_count"), F.col("total_rows") * width).alias("missing_pct"),
        "null_columns",
        percentage(F.col("null_columns"), width).alias("null_col_ratio"),
    )


def outlier_counts(table: DataFrame, fences: list[Fences]) -> DataFrame:
    """AGG4 per column: cells below and above the fences, one scan."""
    entries = []
    for place, fence in enumerate(fences):
        value = quoted(fence.column).cast("double")
        entries.append(
            F.struct(
                F.lit(place).alias("position"),
                F.lit(fence.column).alias("column"),
                F.count(value).alias("non_null"),
                F.lit(fence.q1).alias("q1"),
                F.lit(fence.q3).alias("q3"),
                F.lit(fence.lower).alias("lower_bound"),
                F.lit(fence.upper).alias("upper_bound"),
                F.count_if(below(fence)).alias("low_count"),
                F.count_if(above(fence)).alias("high_count"),
            ).alias(f"f{place}")
        )
    if not entries:
        schema = (
            "position int, column string, non_null bigint, q1 double, q3 double, "
            "lower_bound double, upper_bound double, low_count bigint, high_count bigint"
        )
        return table.sparkSession.createDataFrame([], schema)
    counted = table.agg(*entries)
    return counted.select(F.inline(F.array(*[f"f{i}" for i in range(len(entries))])))


def quality_metrics(profile: TableProfile) -> DataFrame:
    """The eleven metrics of a profiled table; left to do are counting outliers, one scan,
    and copies among the rows that share a digest."""
    used = [fence for fence in profile.fences if fence.usable]
    skews = {column.column: abs(column.skewness or 0.0) for column in profile.columns}
    mean_skew = sum(skews[fence.column] for fence in used) / len(used) if used else 0.0
    mixed = sum(is_mixed_column(column) for column in profile.columns)
    missing = sum(profile.nulls.values())
    with_nulls = sum(count > 0 for count in profile.nulls.values())
    counted = profile.table.agg(
        F.count("*").alias("total_rows"),
        total(F.count_if(outside(fence)) for fence in used).alias("outlier_count"),
        total(F.count(quoted(fence.column)) for fence in used).alias("fenced_cells"),
    ).select("*", profile.duplicates.count_distinct().scalar().alias("distinct_rows"))
    return counted.select(
        *metric_columns(
            len(profile.columns),
            missing=F.lit(missing),
            copies=F.col("total_rows") - F.col("distinct_rows"),
            mixed=F.lit(mixed),
            with_nulls=F.lit(with_nulls),
            constant=F.lit(len(profile.constant)),
            mean_skew=F.lit(float(mean_skew)),
        )
    )


def metric_columns(
    columns: int,
    missing: Column,
    copies: Column,
    mixed: Column,
    with_nulls: Column,
    constant: Column,
    mean_skew: Column,
) -> list[Column]:
    """AGG9's metrics from counts; ``total_rows``, ``outlier_count`` and ``fenced_cells`` are
    columns of the row."""
    width, rows = F.lit(columns), F.col("total_rows")
    return [
        rows,
        missing.cast("long").alias("missing_count"),
        percentage(missing, rows * width).alias("missing_pct"),
        copies.alias("duplicate_count"),
        percentage(copies, rows).alias("duplicate_pct"),
        F.col("outlier_count"),
        percentage(F.col("outlier_count"), F.col("fenced_cells")).alias("outlier_pct"),
        percentage(mixed, width).alias("type_inconsistency_pct"),
        percentage(with_nulls, width).alias("null_col_ratio"),
        percentage(constant, width).alias("constant_col_ratio"),
        round_exact(mean_skew, 3).alias("avg_skewness"),
    ]


def analyze_quality(
    df: DataFrame, key: str | None = None, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """AGG9: one row with the eleven quality metrics.

    Passes: one scan for all column statistics, the quartile search, the digest shuffle of a
    large table, and the scan left in the returned plan.  The driver holds no more than a
    few numbers per column."""
    require_rows(df)
    return quality_metrics(fit_profile(normalize_missing(df, key), key, limits))


def mixed_type_columns(table: DataFrame, key: str | None = None) -> DataFrame:
    """AGG6 per text column of a normalized table."""
    non_null = F.col("total_rows") - F.col("null_count")
    return (
        column_statistics(table, key)
        .where(F.col("data_type") == T.StringType().simpleString())
        .select(
            "column",
            non_null.alias("non_null"),
            "numeric_ratio",
            is_mixed(F.col("numeric_ratio"), non_null).alias("is_mixed"),
        )
    )
