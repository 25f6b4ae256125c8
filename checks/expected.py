"""SQL building blocks that state what the operators must return."""

from __future__ import annotations

from checks.tables import DIRTY, GAPS, KINDS, REPORT_TEXT

# Fixed values, written out so that a wrong one in the engine shows.
MISSING_TOKENS = ("", "na", "n/a", "nan", "null", "none", "missing", "unknown", "-", "--")
NUMBER_PATTERN = (
    r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
)
PENALTIES = {
    "missing_pct": 0.30, "duplicate_pct": 0.25, "outlier_pct": 0.15, "type_inconsistency_pct": 0.12,
    "null_col_ratio": 0.08, "constant_col_ratio": 0.05, "avg_skewness": 0.50,
}
SKEWNESS_PENALTY_CAP = 10.0

SOURCES = {
    "dirty": DIRTY.format(orders="orders"),
    "gaps": GAPS.format(labels="labels"),
    "reports": REPORT_TEXT.format(documents="documents"),
}
KEYED = ("dirty", "gaps")

METRICS = (
    "total_rows", "missing_count", "missing_pct", "duplicate_count", "duplicate_pct",
    "outlier_count", "outlier_pct", "type_inconsistency_pct", "null_col_ratio",
    "constant_col_ratio", "avg_skewness",
)


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    seen: dict[str, str] = {}
    for name, body in ctes:
        seen.setdefault(name, body)
    listed = ",\n".join(f"{name} AS ({body})" for name, body in seen.items())
    return f"WITH {listed}\n{final}" if listed else final


def rounded(x: str, digits: int, up: bool = False) -> str:
    """Nearest decimal of the exact double; ties to even, or up."""
    s = f"CAST({10 ** digits} AS DOUBLE)"
    p = f"(({x}) * {s})"
    c = f"(({x}) * CAST(134217729 AS DOUBLE))"
    high = f"({c} - ({c} - ({x})))"
    rest = f"(({high} * {s} - {p}) + (({x}) - {high}) * {s})"
    over = f"({p} - (floor({p}) + 0.5::DOUBLE))"
    tie = "true" if up else f"(abs(floor({p})) % 2 = 1)"
    step = f"({over} > 0 OR ({over} = 0 AND ({rest} > 0 OR ({rest} = 0 AND {tie}))))"
    return f"((floor({p}) + CASE WHEN {step} THEN 1::DOUBLE ELSE 0::DOUBLE END) / {s})"


def pct(part: str, whole: str) -> str:
    ratio = f"(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100::DOUBLE)"
    return f"CASE WHEN ({whole}) = 0 THEN 0::DOUBLE ELSE {rounded(ratio, 2)} END"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def is_number(x: str) -> str:
    return f"regexp_matches({x}, '{NUMBER_PATTERN}')"


def normalized_column(name: str, kind: str) -> str:
    if kind != "t":
        return name
    tokens = ", ".join(f"'{token}'" for token in MISSING_TOKENS)
    return f"CASE WHEN lower({trimmed(name)}) IN ({tokens}) THEN NULL ELSE {name} END AS {name}"


def source(name: str) -> list[tuple[str, str]]:
    return [(name, SOURCES[name])] if name in SOURCES else []


def normalized(name: str, kinds: dict[str, str], out: str, keyed: bool) -> tuple[str, str]:
    columns = [normalized_column(column, kind) for column, kind in kinds.items()]
    key = "row_id, " if keyed else ""
    return out, f"SELECT {key}{', '.join(columns)} FROM {name}"


def _names(kinds: dict[str, str], kind: str) -> list[str]:
    return [column for column, k in kinds.items() if k == kind]


def skew(x: str) -> str:
    return f"coalesce(CASE WHEN isnan(skewness({x})) THEN 0 ELSE skewness({x}) END, 0::DOUBLE)"


def fence_rows(table: str, columns: list[str]) -> str:
    """(position, column_name, n, q1, q3, lower_bound, upper_bound, usable, low, high, skew)."""
    parts = []
    for place, c in enumerate(columns):
        parts.append(
            f"""SELECT {place} AS position, '{c}' AS column_name, n, q1, q3,
              q1 - 1.5::DOUBLE * (q3 - q1) AS lower_bound,
              q3 + 1.5::DOUBLE * (q3 - q1) AS upper_bound,
              coalesce(n >= 4 AND q3 - q1 <> 0, false) AS usable, skew,
              (SELECT count(*) FROM {table} WHERE CAST({c} AS DOUBLE) < q1 - 1.5::DOUBLE * (q3 - q1)) AS low_count,
              (SELECT count(*) FROM {table} WHERE CAST({c} AS DOUBLE) > q3 + 1.5::DOUBLE * (q3 - q1)) AS high_count
            FROM (SELECT count({c}) AS n, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
                    quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3,
                    {skew(f'CAST({c} AS DOUBLE)')} AS skew FROM {table}) s"""
        )
    return "\nUNION ALL ".join(parts)


def metrics(name: str, kinds: dict[str, str], keyed: bool, out: str) -> list[tuple[str, str]]:
    """CTEs ending in ``out``, one row with the eleven metrics of relation ``name``."""
    n = f"{out}_n"
    columns = ", ".join(kinds)
    numeric, text = _names(kinds, "n"), _names(kinds, "t")
    nulls = [f"count(*) - count({c})" for c in kinds]
    constant = [
        f"CASE WHEN count({c}) = 0 OR (count({c}) = count(*) AND min({c}) = max({c})) THEN 1 ELSE 0 END"
        for c in kinds
    ]
    mixed = [
        f"""CASE WHEN count({c}) >= 5
            AND avg(CASE WHEN {c} IS NULL THEN NULL WHEN {is_number(c)} THEN 1::DOUBLE ELSE 0::DOUBLE END) > 0.10::DOUBLE
            AND avg(CASE WHEN {c} IS NULL THEN NULL WHEN {is_number(c)} THEN 1::DOUBLE ELSE 0::DOUBLE END) < 0.90::DOUBLE
            THEN 1 ELSE 0 END"""
        for c in text
    ]
    width = len(kinds)
    return [
        normalized(name, kinds, n, keyed),
        (f"{out}_f", fence_rows(n, numeric)),
        (
            f"{out}_a",
            f"""SELECT count(*) AS total_rows, {' + '.join(nulls)} AS missing,
              {' + '.join(f'CASE WHEN {x} > 0 THEN 1 ELSE 0 END' for x in nulls)} AS null_columns,
              {' + '.join(constant)} AS constants, {' + '.join(mixed or ['0'])} AS mixed FROM {n}""",
        ),
        (f"{out}_d", f"SELECT count(*) AS distinct_rows FROM (SELECT DISTINCT {columns} FROM {n}) d"),
        (
            f"{out}_o",
            f"""SELECT coalesce(sum(low_count + high_count), 0) AS outliers,
              coalesce(sum(n), 0) AS cells, coalesce(avg(abs(skew)), 0) AS mean_skew
              FROM {out}_f WHERE usable""",
        ),
        (
            out,
            f"""SELECT total_rows, CAST(missing AS BIGINT) AS missing_count,
              {pct('missing', f'total_rows * {width}')} AS missing_pct,
              total_rows - distinct_rows AS duplicate_count,
              {pct('(total_rows - distinct_rows)', 'total_rows')} AS duplicate_pct,
              CAST(outliers AS BIGINT) AS outlier_count, {pct('outliers', 'cells')} AS outlier_pct,
              {pct('mixed', str(width))} AS type_inconsistency_pct,
              {pct('null_columns', str(width))} AS null_col_ratio,
              {pct('constants', str(width))} AS constant_col_ratio,
              {rounded('mean_skew', 3)} AS avg_skewness
              FROM {out}_a, {out}_d, {out}_o""",
        ),
    ]


def table_metrics(name: str, out: str | None = None) -> list[tuple[str, str]]:
    return source(name) + metrics(name, KINDS[name], name in KEYED, out or f"{name}_m")


def score() -> str:
    """The penalty formula over the metric columns, unrounded."""
    lost = [
        f"least(avg_skewness * {w}::DOUBLE, {SKEWNESS_PENALTY_CAP}::DOUBLE)"
        if name == "avg_skewness"
        else f"{name} * {w}::DOUBLE"
        for name, w in PENALTIES.items()
    ]
    return f"greatest(0::DOUBLE, least(100::DOUBLE, 100::DOUBLE - {' - '.join(lost)}))"


def scored(name: str) -> tuple[str, str]:
    return f"{name}_s", f"SELECT *, {rounded(score(), 2)} AS trust_score FROM {name}"


# ── cleaning ─────────────────────────────────────────────────────────────────────────────


def unique_rows(table: str, kinds: dict[str, str], out: str) -> tuple[str, str]:
    columns = ", ".join(kinds)
    return out, f"SELECT min(row_id) AS row_id, {columns} FROM {table} GROUP BY {columns}"


def numeric_plan(unique: str, kinds: dict[str, str]) -> str:
    parts = []
    for c in _names(kinds, "n"):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"""SELECT '{c}' AS column_name, gaps AS filled_count,
              CASE WHEN n = 0 THEN 'constant_0_all_missing'
                   WHEN n >= 3 AND abs(skew) > 1 THEN 'median_skewed_numeric'
                   ELSE 'mean_near_symmetric_numeric' END AS strategy,
              CASE WHEN n = 0 THEN 0::DOUBLE WHEN n >= 3 AND abs(skew) > 1 THEN middle
                   ELSE mean END AS fill_value
            FROM (SELECT count({c}) AS n, count(*) - count({c}) AS gaps, {skew(x)} AS skew,
                    quantile_cont({x}, 0.5) AS middle, avg({x}) AS mean FROM {unique}) s
            WHERE gaps > 0"""
        )
    return "\nUNION ALL ".join(parts)


def text_plan(unique: str, kinds: dict[str, str]) -> str:
    parts = []
    for c in _names(kinds, "t"):
        parts.append(
            f"""SELECT '{c}' AS column_name, gaps AS filled_count,
              CASE WHEN n = 0 THEN 'placeholder_all_missing'
                   WHEN n >= 20 AND CAST(d AS DOUBLE) / n > 0.9::DOUBLE THEN 'placeholder_high_cardinality'
                   ELSE 'mode_categorical' END AS strategy,
              CASE WHEN n = 0 OR (n >= 20 AND CAST(d AS DOUBLE) / n > 0.9::DOUBLE) THEN 'Unknown'
                   ELSE (SELECT {c} FROM {unique} WHERE {c} IS NOT NULL GROUP BY {c}
                         ORDER BY count(*) DESC, {c} LIMIT 1) END AS fill_value
            FROM (SELECT count({c}) AS n, count(DISTINCT {c}) AS d,
                    count(*) - count({c}) AS gaps FROM {unique}) s
            WHERE gaps > 0"""
        )
    return "\nUNION ALL ".join(parts)


def cleaning(name: str, kinds: dict[str, str], p: str) -> list[tuple[str, str]]:
    """CTEs p_n (normalized), p_u (unique), p_np, p_tp (plans), p_i (filled), p_f (fences),
    p_c (clipped), each keyed by row_id."""
    numeric = _names(kinds, "n")

    def fill(c: str, kind: str) -> str:
        if kind == "o":
            return c
        plan = f"{p}_np" if kind == "n" else f"{p}_tp"
        # A column without gaps keeps its type; the sum of both is a double only if filled.
        value = f"CAST({c} AS DOUBLE)" if kind == "n" else c
        return f"coalesce({value}, (SELECT fill_value FROM {plan} WHERE column_name = '{c}')) AS {c}"

    def clip(c: str, kind: str) -> str:
        if kind != "n":
            return c
        pick = f"FROM {p}_f WHERE column_name = '{c}' AND usable AND low_count + high_count > 0"
        low = f"(SELECT lower_bound {pick})"
        high = f"(SELECT upper_bound {pick})"
        return f"CASE WHEN {low} IS NULL THEN {c} ELSE greatest({low}, least({high}, {c})) END AS {c}"

    return [
        normalized(name, kinds, f"{p}_n", True),
        unique_rows(f"{p}_n", kinds, f"{p}_u"),
        (f"{p}_np", numeric_plan(f"{p}_u", kinds)),
        (f"{p}_tp", text_plan(f"{p}_u", kinds)),
        (f"{p}_i", "SELECT row_id, " + ", ".join(fill(c, k) for c, k in kinds.items()) + f" FROM {p}_u"),
        (f"{p}_f", fence_rows(f"{p}_i", numeric)),
        (f"{p}_c", "SELECT row_id, " + ", ".join(clip(c, k) for c, k in kinds.items()) + f" FROM {p}_i"),
    ]


def audit(kinds: dict[str, str], p: str) -> tuple[str, str]:
    """p_r, one row: the numbers of the cleaning report."""

    def gaps(table: str) -> str:
        return f"(SELECT {' + '.join(f'count(*) - count({c})' for c in kinds)} FROM {table})"

    columns = ", ".join(kinds)
    return (
        f"{p}_r",
        f"""SELECT (SELECT count(*) FROM {p}_n) - (SELECT count(*) FROM {p}_u) AS duplicates_removed,
          {gaps(f'{p}_n')} AS missing_before, {gaps(f'{p}_c')} AS missing_after,
          (SELECT CAST(coalesce(sum(low_count + high_count), 0) AS BIGINT) FROM {p}_f WHERE usable) AS clipped,
          {gaps(f'{p}_c')} = 0 AS no_missing_values,
          (SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {p}_c) d)
            = (SELECT count(*) FROM {p}_c) AS no_duplicate_rows""",
    )


# ── corruption ───────────────────────────────────────────────────────────────────────────


def cell_hash(label: str, seed: int) -> str:
    digest = f"md5(concat(CAST(row_id AS STRING), '|{seed}'))"

    def number(text: str) -> str:
        return f"CAST(concat('0x', {text}) AS BIGINT)"

    base, mix = number(f"substr({digest}, 1, 13)"), number(f"substr({digest}, 14, 6)")
    factor = number(f"substr(md5('{label}|{seed}'), 1, 9)")
    return f"(({mix} * {factor} + {base}) % {16**13})"


def masked_cells(name: str, kinds: dict[str, str], fraction: float, seed: int) -> str:
    parts = []
    for c in kinds:
        parts.append(
            f"""SELECT row_id, '{c}' AS column_name FROM (
                SELECT row_id, row_number() OVER (ORDER BY {cell_hash(c, seed)}, row_id) AS place,
                       count(*) OVER () AS n FROM {name} WHERE {c} IS NOT NULL) s
              WHERE place <= least(n, greatest(1, CAST(floor(n * {fraction}::DOUBLE) AS BIGINT)))"""
        )
    return "\nUNION ALL ".join(parts)
