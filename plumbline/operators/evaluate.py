"""How well cleaning works, measured by controlled corruption (EVA1 to EVA5)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import data_fields, is_categorical, is_numeric, quoted
from plumbline.functions.rounding import percentage, round_exact
from plumbline.limits import DEFAULT_LIMITS, Limits
from plumbline.operators.clean import clean_data, keep_one_copy, null_counts
from plumbline.operators.distinct import count_distinct_rows, find_duplicates
from plumbline.operators.normalize import normalize_missing
from plumbline.operators.profile import (
    fit_fences,
    numeric_names,
    outside,
    require_rows,
    total,
)
from plumbline.operators.sampling import Cut, fit_cuts, with_row_hash
from plumbline.storage import settle

# Range of the corruption fractions, accepted error and weights of the score.
FRACTION_RANGE = (0.01, 0.5)
RELATIVE_TOLERANCE = 0.05
ABSOLUTE_TOLERANCE = 1e-9
WEIGHTS = {"imputation": 0.60, "duplicates": 0.25, "outliers": 0.15}

_ROW_LABEL = "row"


def with_row_key(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Numbers the rows once and for all: the numbers are stored, not recomputed."""
    return settle(df.withColumn(key, F.monotonically_increasing_id()), "keyed-rows")


def _present(field: T.StructField) -> Column:
    value = quoted(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


@dataclass(frozen=True)
class Masking:
    """Which cells of which columns are blanked, as filters on the row key."""

    key: str
    seed: int
    cuts: dict[str, Cut]
    sizes: dict[str, int]
    # Columns without nulls of a number or boolean type are compared as numbers.
    numeric: tuple[str, ...]

    def masked(self, column: str) -> Column:
        return self.cuts[column].chosen(self.key, column, self.seed)

    def apply(self, df: DataFrame) -> DataFrame:
        def cell(f: T.StructField) -> Column:
            if f.name not in self.cuts:
                return quoted(f.name)
            keep = ~(_present(f) & self.masked(f.name))
            return F.when(keep, quoted(f.name)).alias(f.name)

        hashed = with_row_hash(df, self.key, self.seed)
        return hashed.select(*[cell(f) for f in df.schema.fields])


def fit_masking(
    df: DataFrame, key: str, fraction: float, seed: int, limits: Limits = DEFAULT_LIMITS
) -> Masking:
    """EVA1: ``max(1, floor(n * fraction))`` of the present cells of each column."""
    fields = [f for f in data_fields(df, key) if is_numeric(f) or is_categorical(f)]
    row = df.agg(
        F.count("*"), *[F.count_if(_present(f)).alias(f"n{i}") for i, f in enumerate(fields)]
    ).first()
    present = {f.name: row[i + 1] for i, f in enumerate(fields)}
    sizes = {name: min(n, max(1, int(n * fraction))) for name, n in present.items() if n}
    eligible = {f.name: _present(f) for f in fields if present[f.name]}
    cuts = fit_cuts(df, key, eligible, present, sizes, seed, limits)
    numeric = tuple(
        f.name
        for f in fields
        if f.name in sizes
        and (
            is_numeric(f)
            or (isinstance(f.dataType, T.BooleanType) and present[f.name] == row[0])
        )
    )
    return Masking(key, seed, cuts, sizes, numeric)


def masked_cells(df: DataFrame, masking: Masking) -> DataFrame:
    """The sample in long form: (key, column), one row per blanked cell."""
    fields = {f.name: f for f in df.schema.fields}
    flags = [
        F.when(_present(fields[name]) & masking.masked(name), F.lit(name)) for name in masking.cuts
    ]
    return with_row_hash(df, masking.key, masking.seed).select(
        quoted(masking.key), F.explode(F.array_compact(F.array(*flags))).alias("column")
    )


def imputation_accuracy(
    df: DataFrame,
    key: str,
    fraction: float = 0.1,
    seed: int = 42,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """EVA2, JOIN1: blank known cells, clean, and look the true values up by row key.

    A blanked cell whose row went as a duplicate counts as missed."""
    masking = fit_masking(df, key, fraction, seed, limits)
    masked = masking.apply(df)
    cleaned = clean_data(masked, key, limits, validate=False).frame
    fields = {f.name: f for f in df.schema.fields}
    after = cleaned.select(
        quoted(key).alias("__key"),
        *[quoted(name).alias(f"__p{i}") for i, name in enumerate(masking.cuts)],
    )
    joined = with_row_hash(df, key, seed).join(after, quoted(key) == F.col("__key"))
    hits, errors, matches = [], [], []
    for place, name in enumerate(masking.cuts):
        tested = _present(fields[name]) & masking.masked(name)
        guess = F.col(f"__p{place}")
        if name in masking.numeric:
            truth = quoted(name).cast("double")
            error = F.abs(guess.cast("double") - truth)
            allowed = F.greatest(F.abs(truth) * RELATIVE_TOLERANCE, F.lit(ABSOLUTE_TOLERANCE))
            hits.append(F.count_if(tested & (error <= allowed)))
            errors.append(F.coalesce(F.sum(F.when(tested, error)), F.lit(0.0)))
        else:
            same = quoted(name).cast("string") == guess.cast("string")
            matches.append(F.count_if(tested & same))
    numeric_total = sum(n for name, n in masking.sizes.items() if name in masking.numeric)
    text_total = sum(masking.sizes.values()) - numeric_total
    counted = joined.agg(
        total(hits).alias("hits"),
        total(matches).alias("matches"),
        total(errors).cast("double").alias("errors"),
    )
    mae = F.try_divide(F.col("errors"), F.lit(float(numeric_total)))
    return counted.select(
        F.lit(numeric_total + text_total).cast("long").alias("masked_cells"),
        F.lit(numeric_total).cast("long").alias("numeric_masked"),
        F.lit(text_total).cast("long").alias("categorical_masked"),
        percentage(F.col("hits"), F.lit(numeric_total)).alias("numeric_within_5pct_accuracy"),
        percentage(F.col("matches"), F.lit(text_total)).alias("categorical_exact_match_accuracy"),
        F.coalesce(round_exact(mae, 6), F.lit(0.0)).alias("numeric_mae"),
        percentage(F.col("hits") + F.col("matches"), F.lit(numeric_total + text_total)).alias(
            "overall_imputation_accuracy"
        ),
    )


def duplicate_fix_accuracy(
    df: DataFrame,
    key: str,
    fraction: float = 0.1,
    seed: int = 42,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """EVA3: add copies of sampled rows and count how many cleaning takes out.

    Only the deduplicating step of cleaning changes the number of rows, so only it runs."""
    rows = df.count()
    if rows == 0:
        return df.sparkSession.sql(
            "SELECT 0L AS injected_duplicates, 0L AS duplicates_removed, "
            "CAST(100.0 AS DOUBLE) AS duplicate_fix_accuracy"
        )
    unique = keep_one_copy(find_duplicates(df, rows, key, limits))
    expected = unique.count()
    injected = min(expected, max(1, int(expected * fraction)))
    cut = fit_cuts(
        unique,
        key,
        {_ROW_LABEL: F.lit(True)},
        {_ROW_LABEL: expected},
        {_ROW_LABEL: injected},
        seed,
        limits,
    )[_ROW_LABEL]
    hashed = with_row_hash(unique, key, seed)
    copies = hashed.where(cut.chosen(key, _ROW_LABEL, seed))
    copies = copies.select(*[quoted(name) for name in unique.columns])
    corrupted = normalize_missing(unique.unionByName(copies), key)
    left = count_distinct_rows(corrupted, expected + injected, key, limits)
    surplus = F.greatest(F.col("distinct_rows") - expected, F.lit(0).cast("long"))
    removed = F.greatest(F.lit(injected) - surplus, F.lit(0).cast("long"))
    return left.select(
        F.lit(injected).cast("long").alias("injected_duplicates"),
        removed.alias("duplicates_removed"),
        percentage(removed, F.lit(injected)).alias("duplicate_fix_accuracy"),
    )


def count_outliers(df: DataFrame, key: str | None, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """One row: ``outlier_count`` over all numeric columns with usable fences."""
    table = normalize_missing(df, key)
    rows, nulls = null_counts(table, key)
    non_null = {name: rows - nulls[name] for name in numeric_names(table, key)}
    used = [fence for fence in fit_fences(table, non_null, limits) if fence.usable]
    return table.agg(total(F.count_if(outside(fence)) for fence in used).alias("outlier_count"))


def outlier_fix_effectiveness(
    df: DataFrame, key: str | None = None, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """EVA4: share of outliers gone after cleaning; 0.0 where there were none."""
    before = count_outliers(df, key, limits)
    cleaned = clean_data(df, key, limits, validate=False).frame
    after = count_outliers(cleaned, key, limits)
    counts = before.select(
        F.col("outlier_count").alias("outlier_count_before"),
        after.scalar().alias("outlier_count_after"),
    )
    gone = F.greatest(
        F.col("outlier_count_before") - F.col("outlier_count_after"), F.lit(0).cast("long")
    )
    return counts.select(
        "*", percentage(gone, F.col("outlier_count_before")).alias("outlier_reduction_pct")
    )


def clamp_fraction(fraction: float) -> float:
    low, high = FRACTION_RANGE
    return min(max(fraction, low), high)


def evaluate_cleaning_accuracy(
    df: DataFrame,
    key: str | None = None,
    mask_fraction: float = 0.1,
    duplicate_fraction: float = 0.1,
    random_state: int = 42,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """EVA5: one row of four structs.  Without a row key the rows are numbered first."""
    require_rows(df)
    if key is None:
        key = "row_id"
        df = with_row_key(df, key)
    mask_fraction = clamp_fraction(mask_fraction)
    duplicate_fraction = clamp_fraction(duplicate_fraction)
    imputation = imputation_accuracy(df, key, mask_fraction, random_state, limits)
    duplicates = duplicate_fix_accuracy(df, key, duplicate_fraction, random_state, limits)
    outliers = outlier_fix_effectiveness(df, key, limits)

    def packed(part: DataFrame) -> Column:
        return part.select(F.struct(*part.columns).alias("part")).scalar()

    parts = df.sparkSession.range(1).select(
        packed(imputation).alias("imputation_accuracy"),
        packed(duplicates).alias("duplicate_fix"),
        packed(outliers).alias("outlier_fix"),
    )
    score = (
        F.col("imputation_accuracy.overall_imputation_accuracy") * WEIGHTS["imputation"]
        + F.col("duplicate_fix.duplicate_fix_accuracy") * WEIGHTS["duplicates"]
        + F.col("outlier_fix.outlier_reduction_pct") * WEIGHTS["outliers"]
    )
    return parts.select(
        F.struct(
            F.lit(mask_fraction).alias("mask_fraction"),
            F.lit(duplicate_fraction).alias("duplicate_fraction"),
            F.lit(random_state).cast("long").alias("random_state"),
            round_exact(score, 2).alias("overall_cleaning_accuracy_score"),
        ).alias("evaluation"),
        "imputation_accuracy",
        "duplicate_fix",
        "outlier_fix",
    )
