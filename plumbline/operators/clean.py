"""Repairing a table (CLN1 to CLN8): one copy of each row, filled cells, clipped outliers.

Every step is fitted on the data as the step before left it, then applied as a projection:
the fitted state is a few numbers per column.  The expensive part, one copy of each row, is
computed once; later passes read its result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    data_fields,
    is_categorical,
    is_numeric,
    is_text,
    quoted,
)
from plumbline.limits import DEFAULT_LIMITS, Limits
from plumbline.operators.distinct import (
    DuplicateSearch,
    count_distinct_rows,
    find_duplicates,
)
from plumbline.operators.normalize import normalize_missing
from plumbline.operators.order_stats import quantiles
from plumbline.operators.profile import (
    Fences,
    TableProfile,
    above,
    below,
    fit_fences,
    numeric_names,
    require_rows,
    sample_skewness,
)
from plumbline.operators.value_counts import count_values
from plumbline.storage import settle

# Fill of text columns without a usable mode, and the rule names in reports.
PLACEHOLDER = "Unknown"
ALL_MISSING_NUMBER = "constant_0_all_missing"
MEDIAN = "median_skewed_numeric"
MEAN = "mean_near_symmetric_numeric"
ALL_MISSING_TEXT = "placeholder_all_missing"
HIGH_CARDINALITY = "placeholder_high_cardinality"
MODE = "mode_categorical"

# Limits of the fill rules.
SKEW_LIMIT = 1.0
CARDINALITY_LIMIT = 0.9
CARDINALITY_MIN_VALUES = 20

REPORT_SCHEMA = (
    "duplicates_removed bigint, missing_before bigint, missing_after bigint, "
    "imputations array<struct<column: string, strategy: string, filled_count: bigint, "
    "fill_value: string>>, "
    "outlier_clipping array<struct<column: string, lower_bound: double, upper_bound: double, "
    "clipped_low: bigint, clipped_high: bigint>>, "
    "validation struct<no_missing_values: boolean, no_duplicate_rows: boolean>"
)


@dataclass(frozen=True)
class Imputation:
    column: str
    strategy: str
    filled_count: int
    fill_value: float | str

    def reported(self) -> tuple:
        value = self.fill_value
        shown = str(round(value, 6)) if isinstance(value, float) else value
        return self.column, self.strategy, self.filled_count, shown


@dataclass(frozen=True)
class Clipping:
    fences: Fences
    low_count: int
    high_count: int

    def reported(self) -> tuple:
        return (
            self.fences.column,
            round(self.fences.lower, 6),
            round(self.fences.upper, 6),
            self.low_count,
            self.high_count,
        )


def null_counts(table: DataFrame, key: str | None = None) -> tuple[int, dict[str, int]]:
    """Rows, and nulls per column, from one scan."""
    fields = data_fields(table, key)
    row = table.agg(
        F.count("*"), *[F.count_if(quoted(f.name).isNull()).alias(f.name) for f in fields]
    ).first()
    return row[0], {f.name: row[i + 1] for i, f in enumerate(fields)}


# ── one copy of each row ─────────────────────────────────────────────────────────────────


def keep_one_copy(duplicates: DuplicateSearch) -> DataFrame:
    """CLN1, written once for the later passes.  Where the digests show that no row is
    repeated there is nothing to write, and the passes read the table itself."""
    if duplicates.all_unique:
        return duplicates.df
    return settle(duplicates.keep_one(), "unique-rows")


# ── filling ──────────────────────────────────────────────────────────────────────────────


def fit_numeric_imputations(
    table: DataFrame, columns: list[str], limits: Limits = DEFAULT_LIMITS
) -> list[Imputation]:
    """CLN2: 0 for an empty column, median when skewed, mean otherwise."""
    if not columns:
        return []
    stats = {}
    measures = [F.count("*").alias("rows")]
    for place, name in enumerate(columns):
        value = quoted(name).cast("double")
        measures += [
            F.count(value).alias(f"n{place}"),
            F.avg(value).alias(f"mean{place}"),
            sample_skewness(name).alias(f"skew{place}"),
        ]
    row = table.agg(*measures).first()
    for place, name in enumerate(columns):
        stats[name] = (row[f"n{place}"], row[f"mean{place}"], abs(row[f"skew{place}"]))
    skewed = {name: n for name, (n, _, skew) in stats.items() if n >= 3 and skew > SKEW_LIMIT}
    values = {name: quoted(name).cast("double") for name in skewed}
    medians = quantiles(table, values, skewed, (0.5,), limits)
    plan = []
    for name, (n, mean, _) in stats.items():
        if n == row["rows"]:
            continue
        if n == 0:
            strategy, fill = ALL_MISSING_NUMBER, 0.0
        elif name in medians:
            strategy, fill = MEDIAN, medians[name][0]
        else:
            strategy, fill = MEAN, mean
        # Infinities of both signs have no mean; such a column is filled like an empty one.
        fill = 0.0 if math.isnan(fill) else float(fill)
        plan.append(Imputation(name, strategy, row["rows"] - n, fill))
    return plan


def nearly_unique(non_null: int, distinct: int) -> bool:
    return non_null >= CARDINALITY_MIN_VALUES and distinct / non_null > CARDINALITY_LIMIT


def fit_text_imputations(
    table: DataFrame, rows: int, columns: list[str], limits: Limits = DEFAULT_LIMITS
) -> list[Imputation]:
    """CLN3: a placeholder for empty or nearly unique columns, the mode otherwise."""
    if not columns:
        return []
    counts = count_values(table, columns)
    plan = {}
    for (_, name), (non_null, distinct, _) in counts.summary.items():
        if nearly_unique(non_null, distinct):
            plan[name] = Imputation(name, HIGH_CARDINALITY, rows - non_null, PLACEHOLDER)
    undecided = {place for place in counts.summary if place[1] not in plan}
    for (_, name), mode in counts.modes(undecided).items():
        plan[name] = Imputation(name, MODE, rows - counts.summary[0, name][0], mode)
    for name in columns:
        plan.setdefault(name, Imputation(name, ALL_MISSING_TEXT, rows, PLACEHOLDER))
    return [entry for entry in plan.values() if entry.filled_count > 0]


def fit_imputations(
    table: DataFrame,
    rows: int,
    with_nulls: set[str],
    key: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> list[Imputation]:
    """Fills in column order; columns without nulls are not read again."""
    fields = [f for f in data_fields(table, key) if f.name in with_nulls]
    numeric = [f.name for f in fields if is_numeric(f)]
    categorical = [f.name for f in fields if is_categorical(f)]
    plan = fit_numeric_imputations(table, numeric, limits)
    plan += fit_text_imputations(table, rows, categorical, limits)
    order = {name: place for place, name in enumerate(table.columns)}
    return sorted(plan, key=lambda entry: order[entry.column])


def _filled(f: T.StructField, entry: Imputation) -> Column:
    value = quoted(f.name)
    if is_numeric(f):
        return F.coalesce(value.cast("double"), F.lit(entry.fill_value)).alias(f.name)
    if is_text(f) or entry.strategy != MODE:
        # A placeholder has no calendar or boolean form, so such a column becomes text.
        return F.coalesce(value.cast("string"), F.lit(entry.fill_value)).alias(f.name)
    return F.coalesce(value, F.lit(entry.fill_value).cast(f.dataType)).alias(f.name)


def apply_imputations(table: DataFrame, plan: list[Imputation]) -> DataFrame:
    """CLN4: one projection."""
    fills = {entry.column: entry for entry in plan}
    return table.select(
        *[
            _filled(f, fills[f.name]) if f.name in fills else quoted(f.name)
            for f in table.schema.fields
        ]
    )


# ── clipping ─────────────────────────────────────────────────────────────────────────────


def fit_clippings(
    filled: DataFrame, non_null: dict[str, int], limits: Limits = DEFAULT_LIMITS
) -> tuple[list[Clipping], dict[str, int]]:
    """CLN5: fences of the filled data and how many cells each moves; nulls per other column."""
    fences = [f for f in fit_fences(filled, non_null, limits) if f.usable]
    rest = [name for name in filled.columns if name not in {f.column for f in fences}]
    counts = []
    for place, fence in enumerate(fences):
        counts += [
            F.count_if(below(fence)).alias(f"low{place}"),
            F.count_if(above(fence)).alias(f"high{place}"),
        ]
    nulls = [F.count_if(quoted(name).isNull()).alias(f"null{i}") for i, name in enumerate(rest)]
    row = filled.agg(F.count("*").alias("rows"), *counts, *nulls).first()
    found = [
        Clipping(fence, row[f"low{place}"], row[f"high{place}"])
        for place, fence in enumerate(fences)
    ]
    moved = [entry for entry in found if entry.low_count or entry.high_count]
    return moved, {name: row[f"null{i}"] for i, name in enumerate(rest)}


def apply_clippings(filled: DataFrame, clippings: list[Clipping]) -> DataFrame:
    """PRJ7: only columns with a value outside change, to doubles."""
    fences = {entry.fences.column: entry.fences for entry in clippings}

    def clipped(name: str) -> Column:
        if name not in fences:
            return quoted(name)
        value = quoted(name).cast("double")
        bounded = F.greatest(
            F.lit(fences[name].lower), F.least(F.lit(fences[name].upper), value)
        )
        # greatest and least skip nulls, which must stay.
        return F.when(value.isNotNull(), bounded).alias(name)

    return filled.select(*[clipped(name) for name in filled.columns])


# ── the whole repair ─────────────────────────────────────────────────────────────────────


@dataclass
class CleaningResult:
    frame: DataFrame
    rows: int
    duplicates_removed: int
    missing_before: int
    missing_after: int
    imputations: list[Imputation]
    clippings: list[Clipping]
    # None where the final check was skipped.
    distinct_rows: int | None

    @property
    def no_duplicate_rows(self) -> bool:
        return self.distinct_rows in (None, self.rows)

    def report(self) -> DataFrame:
        """CLN6: the audit of all changes, one row."""
        row = (
            self.duplicates_removed,
            self.missing_before,
            self.missing_after,
            [entry.reported() for entry in self.imputations],
            [entry.reported() for entry in self.clippings],
            (self.missing_after == 0, self.no_duplicate_rows),
        )
        return self.frame.sparkSession.createDataFrame([row], REPORT_SCHEMA)


def clean_data(
    df: DataFrame,
    key: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
    validate: bool = True,
    profile: TableProfile | None = None,
) -> CleaningResult:
    """CLN8.  ``validate=False`` skips the final duplicate check, a shuffle of its own.  With
    the profile of the same table, its counts and digests are not computed again."""
    if profile is not None:
        rows_before, nulls, duplicates = profile.rows, profile.nulls, profile.duplicates
    else:
        require_rows(df)
        table = normalize_missing(df, key)
        rows_before, nulls = null_counts(table, key)
        duplicates = find_duplicates(table, rows_before, key, limits)
    unique = keep_one_copy(duplicates)
    rows = rows_before if duplicates.all_unique else unique.count()
    with_nulls = {name for name, count in nulls.items() if count}
    plan = fit_imputations(unique, rows, with_nulls, key, limits)
    filled = apply_imputations(unique, plan)
    fillable = {entry.column for entry in plan}
    numeric = {name: rows for name in numeric_names(filled, key)}
    clippings, left = fit_clippings(filled, numeric, limits)
    cleaned = apply_clippings(filled, clippings)
    missing_after = sum(n for name, n in left.items() if name not in fillable and name != key)
    distinct = None
    if validate:
        distinct = count_distinct_rows(cleaned, rows, key, limits).first()[0]
    return CleaningResult(
        frame=cleaned,
        rows=rows,
        duplicates_removed=rows_before - rows,
        missing_before=sum(nulls.values()),
        missing_after=missing_after,
        imputations=plan,
        clippings=clippings,
        distinct_rows=distinct,
    )
