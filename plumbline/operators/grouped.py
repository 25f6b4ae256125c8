"""Profiles and repairs of many tables at once (STM1): the files of a batch, told apart by a column.

Each step is one pass over all tables, not one per table: statistics are grouped, quartiles of all
tables and columns are searched together, duplicates are rows equal in the file's number, too, and
fills and fences reach the rows as a small table of literals.  The driver holds a few numbers per
file and column, and a batch has a bounded number of files.

The results are those of ``fit_profile`` and ``clean_data`` on each table alone.  Types are those of
the batch: a column that is filled in one file becomes a double, or text, in all that are cleaned.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import (
    data_fields,
    is_categorical,
    is_numeric,
    is_text,
    quoted,
)
from plumbline.limits import DEFAULT_LIMITS, Limits
from plumbline.operators.clean import (
    ALL_MISSING_NUMBER,
    ALL_MISSING_TEXT,
    HIGH_CARDINALITY,
    MEAN,
    MEDIAN,
    MODE,
    PLACEHOLDER,
    SKEW_LIMIT,
    Clipping,
    Imputation,
    nearly_unique,
)
from plumbline.operators.distinct import DuplicateSearch, find_duplicates
from plumbline.operators.order_stats import finite, interpolated, whole
from plumbline.operators.profile import (
    Fences,
    column_statistics,
    has_variable_width,
    is_mixed_column,
    metric_columns,
    sample_skewness,
    total,
)
from plumbline.operators.value_counts import count_values
from plumbline.storage import settle, small_table

GROUP = "__table"
# Buckets that a searched interval is split into by one pass.
_BUCKETS = 2048
_COLUMNS_PER_SCAN = 8


def _cells(table: DataFrame, names: list[str]) -> DataFrame:
    """(GROUP, slot, value): the non-null numbers."""
    cells = [
        F.struct(F.lit(slot).alias("slot"), quoted(name).cast("double").alias("value"))
        for slot, name in enumerate(names)
    ]
    return table.select(GROUP, F.inline(F.array(*cells))).where(F.col("value").isNotNull())


def grouped_quantiles(
    table: DataFrame, counts: dict[tuple[int, str], int], shares: tuple[float, ...]
) -> dict[tuple[int, str], tuple[float, ...]]:
    """Exact interpolated quantiles per table and column; ``counts`` are the non-null values.

    A pass counts the values below the interval of each wanted rank and in 2,048 buckets of it, with
    their extremes, and the bucket that holds the rank is the next interval.  Only bucket counts
    are shuffled, and the driver sees one bucket per rank."""
    counts = {place: n for place, n in counts.items() if n > 0}
    if not counts:
        return {}
    spark = table.sparkSession
    names = sorted({name for _, name in counts})
    slots = {name: slot for slot, name in enumerate(names)}
    ranks = {
        place: sorted({r for share in shares for r in (math.floor((n - 1) * share), math.ceil((n - 1) * share))})
        for place, n in counts.items()
    }
    cells = _cells(table, names).withColumn("value", finite(F.col("value")))
    pending: dict[tuple[int, int, int], tuple[float, float]] = {}
    for row in cells.groupBy(GROUP, "slot").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect():
        for rank in ranks.get((row[GROUP], names[row.slot]), []):
            pending[row[GROUP], row.slot, rank] = (row.low, row.high)
    found: dict[tuple[int, int, int], float] = {}
    order = Window.partitionBy(GROUP, "slot", "rank").orderBy("bucket")
    while pending:
        state = small_table(
            spark,
            [(*place, *ends) for place, ends in pending.items()],
            f"{GROUP} int; slot int; rank long; low double; high double",
        )
        value, low, high = F.col("value"), F.col("low"), F.col("high")
        # Halved operands: the width of the whole double range would overflow.
        share = F.try_divide(value * 0.5 - low * 0.5, high * 0.5 - low * 0.5)
        inside = F.least(F.floor(share * float(_BUCKETS)).cast("int"), F.lit(_BUCKETS - 1))
        bucket = F.when(value < low, -1).when(value <= high, F.coalesce(inside, F.lit(0)))
        counted = (
            cells.join(F.broadcast(state), [GROUP, "slot"])
            .select(GROUP, "slot", "rank", "value", bucket.alias("bucket"))
            .where("bucket IS NOT NULL")
            .groupBy(GROUP, "slot", "rank", "bucket")
            .agg(F.count("*").alias("cells"), F.min("value").alias("least"), F.max("value").alias("most"))
        )
        chosen = counted.withColumn("upto", F.sum("cells").over(order)).where(
            "bucket >= 0 AND rank < upto AND rank >= upto - cells"
        )
        following = {}
        for row in chosen.collect():
            place = row[GROUP], row.slot, row.rank
            if row.least == row.most or row.rank == row.upto - 1:
                found[place] = row.most
            elif row.rank == row.upto - row.cells:
                found[place] = row.least
            else:
                following[place] = (row.least, row.most)
        if any(place not in found and place not in following for place in pending):
            raise RuntimeError("the table changed while it was searched")
        pending = following
    return {
        (part, name): tuple(
            interpolated(n, share, lambda rank: whole(found[part, slots[name], rank])) for share in shares
        )
        for (part, name), n in counts.items()
    }


@dataclass(frozen=True)
class GroupedProfile:
    """A few numbers per file and column, keyed by the file's number."""

    table: DataFrame
    key: str | None
    rows: dict[int, int]
    columns: dict[int, list]
    fences: dict[int, list[Fences]]
    constant: dict[int, int]
    # None where the copies were known already.
    duplicates: DuplicateSearch | None
    copies: dict[int, int]

    def nulls(self, part: int) -> dict[str, int]:
        return {column.column: column.null_count for column in self.columns[part]}


def _fields(table: DataFrame, key: str | None) -> list:
    return [field for field in data_fields(table, key) if field.name != GROUP]


def _constant(table: DataFrame, columns: dict[int, list], key: str | None) -> dict[int, int]:
    """AGG8 per table: number of columns with one value.  Texts are compared by 128 bits of hash."""
    types = {field.name: field for field in _fields(table, key)}
    likely = {
        (part, row.column): row for part, rows in columns.items() for row in rows if row.may_be_constant
    }
    doubtful = sorted(
        {name for (_, name), row in likely.items() if row.null_count == 0 and has_variable_width(types[name])}
    )
    differing = set()
    if doubtful:
        second = [F.xxhash64(F.lit(1), quoted(name)) for name in doubtful]
        for row in table.groupBy(GROUP).agg(*[F.min(h) == F.max(h) for h in second]).collect():
            differing |= {(row[0], name) for name, same in zip(doubtful, row[1:]) if not same}
    found = dict.fromkeys(columns, 0)
    for part, name in set(likely) - differing:
        found[part] += 1
    # A column of nulls only is constant whatever the hashes say.
    for part, name in differing & set(likely):
        found[part] += likely[part, name].null_count > 0
    return found


def grouped_fences(
    table: DataFrame, non_null: dict[tuple[int, str], int]
) -> dict[tuple[int, str], Fences]:
    """AGG3 per table and column."""
    enough = {place: n for place, n in non_null.items() if n >= 4}
    found = grouped_quantiles(table, enough, (0.25, 0.75))
    return {place: Fences(place[1], enough[place], *ends) for place, ends in found.items()}


def fit_grouped_profile(
    table: DataFrame,
    key: str | None = None,
    limits: Limits = DEFAULT_LIMITS,
    copies: dict[int, int] | None = None,
) -> GroupedProfile:
    """``fit_profile`` of every table of a normalized batch with the column ``__table``.  The
    number of ``copies`` in each, no entry meaning none, may be known already."""
    columns: dict[int, list] = defaultdict(list)
    for row in column_statistics(table, key, GROUP).collect():
        columns[row[GROUP]].append(row)
    for rows in columns.values():
        rows.sort(key=lambda row: row.position)
    rows = {part: found[0].total_rows for part, found in columns.items()}
    numeric = [field.name for field in _fields(table, key) if is_numeric(field)]
    non_null = {
        (part, row.column): row.total_rows - row.null_count
        for part, found in columns.items()
        for row in found
        if row.column in numeric
    }
    ends = grouped_fences(table, non_null)
    fences = {part: [ends[part, name] for name in numeric if (part, name) in ends] for part in columns}
    duplicates = None
    if copies is None:
        duplicates = find_duplicates(table, sum(rows.values()), key, limits)
        copies = duplicates.copies_by(GROUP)
    constant = _constant(table, columns, key)
    return GroupedProfile(table, key, rows, dict(columns), fences, constant, duplicates, copies)


def _fence_rows(fences: dict[int, list[Fences]], names: list[str], table: DataFrame) -> DataFrame:
    """Usable fences as a table; where infinite quartiles leave no fence, nothing is outside."""
    slots = {name: slot for slot, name in enumerate(names)}
    rows = [
        (part, slots[f.column], *(None if math.isnan(end) else end for end in (f.lower, f.upper)))
        for part, found in fences.items()
        for f in found
        if f.usable
    ]
    return small_table(table.sparkSession, rows, f"{GROUP} int; slot int; lower double; upper double")


def _outside(table: DataFrame, fences: dict[int, list[Fences]]) -> dict[tuple[int, str], tuple[int, int, int]]:
    """AGG4 per table and column with a usable fence: cells below, above, and all."""
    names = sorted({f.column for found in fences.values() for f in found if f.usable})
    if not names:
        return {}
    cells = _cells(table, names).join(F.broadcast(_fence_rows(fences, names, table)), [GROUP, "slot"])
    counted = cells.groupBy(GROUP, "slot").agg(
        F.count_if(F.col("value") < F.col("lower")).alias("low"),
        F.count_if(F.col("value") > F.col("upper")).alias("high"),
        F.count("*").alias("cells"),
    )
    return {(row[GROUP], names[row.slot]): (row.low, row.high, row.cells) for row in counted.collect()}


def grouped_metrics(profile: GroupedProfile) -> DataFrame:
    """``__table`` and the eleven metrics of every table."""
    outside = _outside(profile.table, profile.fences)
    rows = []
    for part, columns in sorted(profile.columns.items()):
        used = [f for f in profile.fences[part] if f.usable]
        skews = {column.column: abs(column.skewness or 0.0) for column in columns}
        counted = [outside[part, f.column] for f in used]
        nulls = profile.nulls(part).values()
        rows.append(
            (
                part, profile.rows[part], sum(nulls), profile.copies.get(part, 0), sum(c[0] + c[1] for c in counted),
                sum(c[2] for c in counted), sum(is_mixed_column(c) for c in columns), sum(n > 0 for n in nulls),
                profile.constant[part], sum(skews[f.column] for f in used) / len(used) if used else 0.0,
            )
        )
    counts = small_table(
        profile.table.sparkSession,
        rows,
        f"{GROUP} int; total_rows long; missing long; copies long; outlier_count long; fenced_cells long; "
        "mixed int; with_nulls int; constants int; mean_skew double",
    )
    width = len(_fields(profile.table, profile.key))
    told = metric_columns(
        width, *[F.col(c) for c in ("missing", "copies", "mixed", "with_nulls", "constants", "mean_skew")]
    )
    return counts.select(GROUP, *told)


# ── cleaning ─────────────────────────────────────────────────────────────────────────────


@dataclass
class GroupedCleaning:
    """One cleaned table after the other in ``frame``; the audits by the file's number."""

    frame: DataFrame
    audits: dict[int, tuple]
    # Copies among the cleaned rows.
    copies: dict[int, int]


def _numeric_fills(unique: DataFrame, names: list[str], rows: dict[int, int]) -> dict[tuple[int, str], Imputation]:
    if not names:
        return {}
    stats: dict[tuple[int, str], tuple] = {}
    for start in range(0, len(names), _COLUMNS_PER_SCAN):
        chosen = names[start : start + _COLUMNS_PER_SCAN]
        measures = []
        for place, name in enumerate(chosen):
            value = quoted(name).cast("double")
            measures += [
                F.count(value).alias(f"n{place}"), F.avg(value).alias(f"mean{place}"),
                sample_skewness(name).alias(f"skew{place}"),
            ]
        for row in unique.groupBy(GROUP).agg(*measures).collect():
            for place, name in enumerate(chosen):
                stats[row[GROUP], name] = (row[f"n{place}"], row[f"mean{place}"], abs(row[f"skew{place}"]))
    gaps = {place: found for place, found in stats.items() if found[0] < rows[place[0]]}
    skewed = {place: n for place, (n, _, skew) in gaps.items() if n >= 3 and skew > SKEW_LIMIT}
    medians = grouped_quantiles(unique, skewed, (0.5,))
    plan = {}
    for (part, name), (n, mean, _) in gaps.items():
        if n == 0:
            strategy, fill = ALL_MISSING_NUMBER, 0.0
        elif (part, name) in medians:
            strategy, fill = MEDIAN, medians[part, name][0]
        else:
            strategy, fill = MEAN, mean
        # Infinities of both signs have no mean; such a column is filled like an empty one.
        plan[part, name] = Imputation(name, strategy, rows[part] - n, 0.0 if math.isnan(fill) else float(fill))
    return plan


def _text_fills(unique: DataFrame, names: list[str], rows: dict[int, int]) -> dict[tuple[int, str], Imputation]:
    if not names:
        return {}
    counts = count_values(unique, names, GROUP)
    gaps = {
        (part, name): rows[part] - counts.summary.get((part, name), (0, 0, 0))[0] for part in rows for name in names
    }
    gaps = {place: n for place, n in gaps.items() if n > 0}
    undecided = {place for place in gaps if place in counts.summary and not nearly_unique(*counts.summary[place][:2])}
    modes = counts.modes(undecided)
    plan = {}
    for (part, name), missing in gaps.items():
        if (part, name) in modes:
            strategy, fill = MODE, modes[part, name]
        else:
            strategy = HIGH_CARDINALITY if (part, name) in counts.summary else ALL_MISSING_TEXT
            fill = PLACEHOLDER
        plan[part, name] = Imputation(name, strategy, missing, fill)
    return plan


def _with_literals(frame: DataFrame, rows: list[tuple[int, dict]], name: str, kind: str) -> DataFrame:
    """``frame`` with a map of literals per table in the column ``name``."""
    literals = small_table(frame.sparkSession, rows, f"{GROUP} int; {name} map<string, {kind}>")
    return frame.join(F.broadcast(literals), GROUP, "left")


def _per_table(plan: dict, value) -> list[tuple[int, dict]]:
    found: dict[int, dict] = defaultdict(dict)
    for (part, name), entry in plan.items():
        found[part][name] = value(entry)
    return list(found.items())


def _fill(unique: DataFrame, plan: dict[tuple[int, str], Imputation]) -> DataFrame:
    fields = unique.schema.fields
    numbers = {p: e for p, e in plan.items() if isinstance(e.fill_value, float)}
    texts = {p: e for p, e in plan.items() if isinstance(e.fill_value, str)}
    holding = _with_literals(unique, _per_table(numbers, lambda e: e.fill_value), "__numbers", "double")
    holding = _with_literals(holding, _per_table(texts, lambda e: e.fill_value), "__texts", "string")
    filled_names = {name for _, name in plan}
    placeheld = {name for (_, name), e in texts.items() if e.strategy != MODE}

    def filled(field) -> Column:
        value = quoted(field.name)
        if field.name not in filled_names:
            return value
        key = F.lit(field.name)
        if is_numeric(field):
            return F.coalesce(value.cast("double"), F.try_element_at("__numbers", key)).alias(field.name)
        fill = F.try_element_at("__texts", key)
        if is_text(field) or field.name in placeheld:
            return F.coalesce(value.cast("string"), fill).alias(field.name)
        return F.coalesce(value, fill.cast(field.dataType)).alias(field.name)

    return holding.select(*[filled(field) for field in fields])


def _clip(filled: DataFrame, clippings: dict[tuple[int, str], Clipping]) -> DataFrame:
    names = {name for _, name in clippings}
    if not names:
        return filled
    holding = _with_literals(filled, _per_table(clippings, lambda c: c.fences.lower), "__lower", "double")
    holding = _with_literals(holding, _per_table(clippings, lambda c: c.fences.upper), "__upper", "double")

    def clipped(name: str) -> Column:
        if name not in names:
            return quoted(name)
        value, key = quoted(name).cast("double"), F.lit(name)
        # greatest and least skip nulls: a table without a fence here keeps its values.
        bounded = F.greatest(F.try_element_at("__lower", key), F.least(F.try_element_at("__upper", key), value))
        return F.when(value.isNotNull(), bounded).alias(name)

    return holding.select(*[clipped(name) for name in filled.columns])


def clean_groups(
    profile: GroupedProfile, parts: set[int], limits: Limits = DEFAULT_LIMITS
) -> GroupedCleaning:
    """CLN8 for some tables of a profiled batch: the cleaned rows with their ``__table``, and per
    table (duplicates removed, missing before and after, imputations, clippings, checks)."""
    key = profile.key
    chosen = F.col(GROUP).isin(sorted(parts))
    unique = settle(profile.duplicates.keep_one().where(chosen), "unique-rows")
    rows = {part: profile.rows[part] - profile.copies.get(part, 0) for part in parts}
    fields = _fields(unique, key)
    with_nulls = {name for part in parts for name, n in profile.nulls(part).items() if n}
    plan = _numeric_fills(unique, [f.name for f in fields if is_numeric(f) and f.name in with_nulls], rows)
    plan |= _text_fills(unique, [f.name for f in fields if is_categorical(f) and f.name in with_nulls], rows)
    # Read by each pass of the search for fences and of what follows.
    filled = settle(_fill(unique, plan), "filled")
    numeric = [f.name for f in _fields(filled, key) if is_numeric(f)]
    fences = grouped_fences(filled, {(part, name): rows[part] for part in parts for name in numeric})
    by_part = {part: [fences[part, n] for n in numeric if (part, n) in fences] for part in parts}
    outside = _outside(filled, by_part)
    clippings = {
        place: Clipping(fences[place], low, high) for place, (low, high, _) in outside.items() if low or high
    }
    cleaned = settle(_clip(filled, clippings), "cleaned")
    left = cleaned.groupBy(GROUP).agg(
        total(F.count_if(quoted(f.name).isNull()) for f in _fields(cleaned, key)).alias("missing")
    )
    missing = {row[GROUP]: row.missing for row in left.collect()}
    again = find_duplicates(cleaned, sum(rows.values()), key, limits).copies_by(GROUP)
    order = [f.name for f in fields]
    audits = {}
    for part in parts:
        fills = [plan[part, name].reported() for name in order if (part, name) in plan]
        clips = [clippings[part, name].reported() for name in numeric if (part, name) in clippings]
        audits[part] = (
            profile.copies.get(part, 0), sum(profile.nulls(part).values()), missing[part], fills, clips,
            (missing[part] == 0, again.get(part, 0) == 0),
        )
    return GroupedCleaning(cleaned, audits, again)
