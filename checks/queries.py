"""One query per operator over the test tables, next to the SQL of its expected result."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import expected as E
from checks.tables import KINDS, dirty, gaps, land, report_texts, table
from plumbline.functions.formats import delta_text, percent_text
from plumbline.operators.clean import (
    apply_imputations,
    clean_data,
    fit_clippings,
    fit_imputations,
    fit_numeric_imputations,
    fit_text_imputations,
    null_counts,
)
from plumbline.operators.distinct import distinct_rows, duplicate_summary
from plumbline.operators.evaluate import (
    duplicate_fix_accuracy,
    evaluate_cleaning_accuracy,
    fit_masking,
    imputation_accuracy,
    masked_cells,
    outlier_fix_effectiveness,
)
from plumbline.operators.forest import scaled_training_table, tree_agreement
from plumbline.operators.normalize import normalize_missing
from plumbline.operators.postings import build_postings, postings_topk
from plumbline.operators.profile import (
    analyze_quality,
    column_statistics,
    constant_columns,
    fit_fences,
    missing_summary,
    mixed_type_columns,
    numeric_names,
    outlier_counts,
)
from plumbline.operators.reports import report_metadata, upsert_index
from plumbline.operators.retrieve import (
    answer_context,
    group_centroids,
    text_topk,
    vector_topk,
)
from plumbline.operators.sketches import approximate_fences, column_sketches, rank_error
from plumbline.operators.trust import penalty_score, predict_trust_score
from plumbline.operators.value_counts import modes
from plumbline.operators.vector_index import build_vector_index, search_vectors
from plumbline.operators.views import (
    cleaning_actions,
    cleaning_summary,
    health_grade,
    imputation_preview,
    metric_trend,
    overall_severity,
    quality_dimensions,
    rows_removed,
    run_improvement,
    score_band,
    severity,
)
from plumbline.plans.batch_run import FILE, run_quality_batch
from plumbline.plans.quality_run import QualityRun, run_quality
from plumbline.sources.history import find_run, latest_runs, read_history, shown
from plumbline.sources.readers import read_csv, read_reports, read_table
from plumbline.sources.report_index import read_index, upsert_reports
from plumbline.sources.writers import export_json, export_table
from plumbline.storage import new_path
from plumbline.streaming.ingest import ingest, landing_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
EXPECTED: dict[str, str] = {}

KEY = "row_id"
SEED = 42
FRACTION = 0.1
MOMENT = dt.datetime(2024, 1, 1, 12, 0, 0)
SCORED_TABLES = ("customer", "part", "events", "dirty")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            EXPECTED[name] = sql
        return function

    return register


def _rounded(names: list[str], digits: int) -> list[Column]:
    return [F.round(F.col(name), digits).alias(name) for name in names]


def _source(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, str | None]:
    if name == "dirty":
        return dirty(spark, sf_dir), KEY
    return table(spark, sf_dir, name), None


def _dirty_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_missing(dirty(spark, sf_dir), KEY)


DIRTY_KINDS = KINDS["dirty"]
DIRTY_N = E.source("dirty") + [E.normalized("dirty", DIRTY_KINDS, "n", True)]
DIRTY_CLEAN = E.source("dirty") + E.cleaning("dirty", DIRTY_KINDS, "c")
GAPS_CLEAN = E.source("gaps") + E.cleaning("gaps", KINDS["gaps"], "g")
DIRTY_NUMBERS = [c for c, kind in DIRTY_KINDS.items() if kind == "n"]
DIRTY_TEXTS = [c for c, kind in DIRTY_KINDS.items() if kind == "t"]
WIDTH = len(DIRTY_KINDS)

# ── markers, counts and single metrics ───────────────────────────────────────────────────


@query("normalize_missing", E.with_ctes(DIRTY_N, "SELECT * FROM n"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty_normalized(spark, sf_dir)


@query(
    "missing_cells",
    E.with_ctes(
        DIRTY_N,
        "\nUNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count, count(*) AS total_rows FROM n"
            for c in DIRTY_KINDS
        ),
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = column_statistics(_dirty_normalized(spark, sf_dir), KEY)
    return found.select(F.col("column").alias("column_name"), "null_count", "total_rows")


@query(
    "null_columns",
    E.with_ctes(
        DIRTY_N
        + [
            (
                "a",
                "SELECT count(*) AS total_rows, "
                + " + ".join(f"count(*) - count({c})" for c in DIRTY_KINDS)
                + " AS missing_count, "
                + " + ".join(
                    f"CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END" for c in DIRTY_KINDS
                )
                + " AS null_columns FROM n",
            )
        ],
        f"""SELECT total_rows, missing_count, CAST(null_columns AS BIGINT) AS null_columns,
          {E.pct('missing_count', f'total_rows * {WIDTH}')} AS missing_pct,
          {E.pct('null_columns', str(WIDTH))} AS null_col_ratio FROM a""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_summary(_dirty_normalized(spark, sf_dir), KEY)


def _duplicates_sql(ctes: list[tuple[str, str]], relation: str, columns: str) -> str:
    return E.with_ctes(
        ctes
        + [
            (
                "a",
                f"SELECT (SELECT count(*) FROM {relation}) AS total_rows, "
                f"(SELECT count(*) FROM (SELECT DISTINCT {columns} FROM {relation}) d) AS distinct_rows",
            )
        ],
        f"""SELECT total_rows, distinct_rows, total_rows - distinct_rows AS duplicate_count,
          {E.pct('(total_rows - distinct_rows)', 'total_rows')} AS duplicate_pct FROM a""",
    )


@query("duplicate_rows", _duplicates_sql(DIRTY_N, "n", ", ".join(DIRTY_KINDS)))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _dirty_normalized(spark, sf_dir)
    return duplicate_summary(df, df.count(), KEY)


@query("duplicate_documents", _duplicates_sql([], "documents", "text, lang, source, n_chars"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return duplicate_summary(df, df.count(), "doc_id")


@query("duplicate_labels", _duplicates_sql([], "labels", "quality, toxic"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "labels")
    return duplicate_summary(df, df.count(), "doc_id")


LINEITEM_NUMBERS = [c for c, kind in KINDS["lineitem"].items() if kind == "n"]


@query(
    "iqr_fences",
    E.with_ctes(
        [("f", E.fence_rows("lineitem", LINEITEM_NUMBERS))],
        """SELECT column_name, n AS non_null, round(q1, 6) AS q1, round(q3, 6) AS q3,
          round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound, usable FROM f""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normalize_missing(table(spark, sf_dir, "lineitem"))
    rows, nulls = null_counts(df)
    fences = fit_fences(df, {name: rows - nulls[name] for name in numeric_names(df)})
    return outlier_counts(df, fences).select(
        F.col("column").alias("column_name"),
        "non_null",
        *_rounded(["q1", "q3", "lower_bound", "upper_bound"], 6),
        (F.col("q3") != F.col("q1")).alias("usable"),
    )


@query(
    "iqr_fences_sketched",
    E.with_ctes(
        [("f", E.fence_rows("lineitem", LINEITEM_NUMBERS))],
        "SELECT column_name, n AS non_null, true AS q1_within_error, true AS q3_within_error FROM f",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles from sketches stored per return flag, in two appends; their ranks, counted over
    all rows, must be within the stated error."""
    df = normalize_missing(table(spark, sf_dir, "lineitem"))
    path = new_path(spark, "sketches")
    late = F.coalesce(F.col("l_returnflag") == "R", F.lit(False))
    for part in (df.where(~late), df.where(late)):
        column_sketches(part, F.col("l_returnflag")).write.mode("append").parquet(path)
    fences = approximate_fences(spark.read.parquet(path))
    error = rank_error()
    rows = []
    for fence in fences:
        value, checks = F.col(fence.column).cast("double"), []
        for share, quartile in ((0.25, fence.q1), (0.75, fence.q3)):
            below, reached = F.avg((value < quartile).cast("int")), F.avg((value <= quartile).cast("int"))
            checks.append((below <= share + error) & (reached >= share - error))
        names = ("column_name", "non_null", "q1_within_error", "q3_within_error")
        cells = (F.lit(fence.column), F.lit(fence.non_null).cast("long"), *checks)
        rows.append(F.struct(*[cell.alias(name) for name, cell in zip(names, cells)]))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _outlier_query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df, key = _source(spark, sf_dir, name)
    df = normalize_missing(df, key)
    rows, nulls = null_counts(df, key)
    fences = fit_fences(df, {name: rows - nulls[name] for name in numeric_names(df, key)})
    found = outlier_counts(df, [fence for fence in fences if fence.usable])
    return found.select(F.col("column").alias("column_name"), "non_null", "low_count", "high_count")


_OUTLIER_SQL = "SELECT column_name, n AS non_null, low_count, high_count FROM f WHERE usable"


@query("outliers", E.with_ctes(DIRTY_N + [("f", E.fence_rows("n", DIRTY_NUMBERS))], _OUTLIER_SQL))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlier_query(spark, sf_dir, "dirty")


@query(
    "outliers_events",
    E.with_ctes([("f", E.fence_rows("events", ["event_id", "user_id", "value"]))], _OUTLIER_SQL),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outlier_query(spark, sf_dir, "events")


_TAILS = """SELECT l_orderkey, CASE l_orderkey % 10 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE
  ELSE CAST(l_extendedprice AS DOUBLE) END AS price FROM lineitem"""


@query(
    "outliers_infinite",
    E.with_ctes(
        [("tails", _TAILS), ("f", E.fence_rows("tails", ["price"]))],
        # A column that is mostly infinite has no fences, so nothing in it is outside.
        _OUTLIER_SQL + " UNION ALL SELECT 'mostly', count(*), 0, 0 FROM lineitem",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("l_orderkey"), F.col("l_extendedprice").cast("double")
    infinity = F.lit(float("inf"))
    df = table(spark, sf_dir, "lineitem").select(
        F.when(key % 10 == 0, infinity).when(key % 10 == 1, -infinity).otherwise(price).alias("price"),
        F.when(key % 10 < 8, infinity).otherwise(price).alias("mostly"),
    )
    rows, _ = null_counts(df)
    found = outlier_counts(df, [f for f in fit_fences(df, {"price": rows, "mostly": rows}) if f.usable])
    return found.select(F.col("column").alias("column_name"), "non_null", "low_count", "high_count")


@query(
    "skewness",
    "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, round({E.skew(f'CAST({c} AS DOUBLE)')}, 6) AS skewness FROM lineitem"
        for c in LINEITEM_NUMBERS
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = column_statistics(normalize_missing(table(spark, sf_dir, "lineitem")))
    found = found.where(F.col("skewness").isNotNull())
    return found.select(F.col("column").alias("column_name"), *_rounded(["skewness"], 6))


@query(
    "type_inconsistency",
    E.with_ctes(
        DIRTY_N,
        "\nUNION ALL ".join(
            f"""SELECT column_name, non_null, round(ratio, 6) AS numeric_ratio,
              coalesce(non_null >= 5 AND ratio > 0.10::DOUBLE AND ratio < 0.90::DOUBLE, false) AS is_mixed
            FROM (SELECT '{c}' AS column_name, count({c}) AS non_null,
              avg(CASE WHEN {c} IS NULL THEN NULL WHEN {E.is_number(c)} THEN 1::DOUBLE ELSE 0::DOUBLE END) AS ratio
              FROM n) s"""
            for c in DIRTY_TEXTS
        ),
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed_type_columns(_dirty_normalized(spark, sf_dir), KEY)
    return found.select(
        F.col("column").alias("column_name"), "non_null", *_rounded(["numeric_ratio"], 6), "is_mixed"
    )


@query(
    "constant_columns",
    E.with_ctes(
        DIRTY_N,
        "SELECT column_name FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(DISTINCT {c}) + "
            f"CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END AS kinds FROM n"
            for c in DIRTY_KINDS
        )
        + ") s WHERE kinds <= 1",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _dirty_normalized(spark, sf_dir)
    found = column_statistics(df, KEY)
    constant = constant_columns(df, found.collect())
    return found.where(F.col("column").isin(sorted(constant))).select(
        F.col("column").alias("column_name")
    )


@query(
    "column_modes",
    "\nUNION ALL ".join(
        f"""SELECT '{c}' AS column_name, (SELECT count({c}) FROM documents) AS non_null,
          (SELECT count(DISTINCT {c}) FROM documents) AS distinct_values, {c} AS mode, count(*) AS mode_cells
        FROM documents WHERE {c} IS NOT NULL GROUP BY {c}
        QUALIFY row_number() OVER (ORDER BY count(*) DESC, {c}) = 1"""
        for c in ("lang", "source", "text")
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = modes(table(spark, sf_dir, "documents"), ["lang", "source", "text"])
    return found.withColumnRenamed("column", "column_name")


# ── all metrics, scores and views of them ────────────────────────────────────────────────


def _analysis(name: str) -> None:
    @query(
        "analyze_quality" if name == "dirty" else f"analyze_{name}",
        E.with_ctes(E.table_metrics(name), f"SELECT * FROM {name}_m"),
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return analyze_quality(*_source(spark, sf_dir, name))


for _name in ("dirty", "lineitem", "events"):
    _analysis(_name)


def _all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        analyze_quality(*_source(spark, sf_dir, name)).withColumn("table_name", F.lit(name))
        for name in SCORED_TABLES
    ]
    return reduce(DataFrame.unionByName, parts)


ALL_METRICS = [cte for name in SCORED_TABLES for cte in E.table_metrics(name)] + [
    (
        "m",
        " UNION ALL ".join(f"SELECT '{name}' AS table_name, * FROM {name}_m" for name in SCORED_TABLES),
    )
]


@query(
    "trust_formula",
    E.with_ctes(
        ALL_METRICS, f"SELECT table_name, round({E.score()}, 4) AS trust_score FROM m"
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_metrics(spark, sf_dir).select(
        "table_name", F.round(penalty_score(), 4).alias("trust_score")
    )


def _steps(x: str, steps: list[tuple[int, str]], otherwise: str) -> str:
    whens = " ".join(f"WHEN {x} >= {bound} THEN '{name}'" for bound, name in steps)
    return f"CASE {whens} ELSE '{otherwise}' END"


GRADE_SQL = _steps("trust_score", [(92, "A+"), (80, "A"), (68, "B"), (55, "C"), (40, "D")], "F")
BAND_SQL = _steps("trust_score", [(75, "good"), (50, "fair")], "poor")


@query(
    "quality_grade",
    E.with_ctes(
        ALL_METRICS + [E.scored("m")],
        f"SELECT table_name, trust_score, {GRADE_SQL} AS grade, {BAND_SQL} AS band FROM m_s",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = predict_trust_score(_all_metrics(spark, sf_dir), "formula")
    score = F.col("trust_score")
    return scores.select(
        "table_name",
        "trust_score",
        health_grade(score).alias("grade"),
        score_band(score).alias("band"),
    )


@query(
    "quality_dimensions",
    E.with_ctes(
        ALL_METRICS,
        """SELECT table_name, greatest(0::DOUBLE, 100::DOUBLE - missing_pct) AS completeness,
          greatest(0::DOUBLE, 100::DOUBLE - duplicate_pct) AS uniqueness,
          greatest(0::DOUBLE, 100::DOUBLE - outlier_pct) AS validity FROM m""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_dimensions(_all_metrics(spark, sf_dir)).select(
        "table_name", "completeness", "uniqueness", "validity"
    )


@query(
    "metric_severity",
    E.with_ctes(
        ALL_METRICS,
        """SELECT table_name,
          CASE WHEN missing_pct > 20 THEN 'high' WHEN missing_pct > 5 THEN 'medium' ELSE 'low' END AS missing,
          CASE WHEN duplicate_pct > 20 THEN 'high' WHEN duplicate_pct > 5 THEN 'medium' ELSE 'low' END AS duplicates,
          CASE WHEN outlier_pct > 20 THEN 'high' WHEN outlier_pct > 5 THEN 'medium' ELSE 'low' END AS outliers,
          CASE WHEN (missing_pct + duplicate_pct + outlier_pct) / 3 < 5 THEN 'low'
               WHEN (missing_pct + duplicate_pct + outlier_pct) / 3 < 15 THEN 'medium' ELSE 'high' END AS overall
          FROM m""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = [F.col(name) for name in ("missing_pct", "duplicate_pct", "outlier_pct")]
    return _all_metrics(spark, sf_dir).select(
        "table_name",
        severity(rates[0]).alias("missing"),
        severity(rates[1]).alias("duplicates"),
        severity(rates[2]).alias("outliers"),
        overall_severity(tuple(rates)).alias("overall"),
    )


# Fixed values, written out: the training table's size, ranges and noise.
TRAINING = {
    "missing_pct": 70.0, "duplicate_pct": 60.0, "outlier_pct": 40.0, "type_inconsistency_pct": 50.0,
    "null_col_ratio": 80.0, "constant_col_ratio": 30.0, "avg_skewness": 12.0,
}


def _training_sql() -> list[tuple[str, str]]:
    def uniform(place: int) -> str:
        digest = f"md5(concat('42|{place}|', CAST(row AS VARCHAR)))"
        return f"(CAST(CAST(concat('0x', substr({digest}, 1, 13)) AS BIGINT) AS DOUBLE) / {16**13}::DOUBLE)"

    names = list(TRAINING)
    columns = [f"{uniform(i)} * {high}::DOUBLE AS {name}" for i, (name, high) in enumerate(TRAINING.items())]
    normal = f"sqrt(-2::DOUBLE * ln(1::DOUBLE - {uniform(7)})) * cos(2::DOUBLE * pi() * {uniform(8)}) * 1.5::DOUBLE"
    score = E.score().replace("greatest(0::DOUBLE, least(100::DOUBLE, ", "greatest(0::DOUBLE, least(100::DOUBLE, noise + ")
    scaled = [
        f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 9) AS scaled_{c}" for c in names
    ]
    return [
        ("numbers", "SELECT unnest(range(1500)) AS row"),
        ("drawn", f"SELECT row, {', '.join(columns)}, {normal} AS noise FROM numbers"),
        ("labelled", f"SELECT *, {score} AS trust_score FROM drawn"),
        (
            "training",
            f"""SELECT row, {', '.join(f"round({c}, 9) AS {c}" for c in names)}, round(trust_score, 9) AS trust_score,
              {', '.join(scaled)} FROM labelled""",
        ),
    ]


@query(
    "forest_training",
    E.with_ctes(
        sum([E.table_metrics(name) for name in ("customer",)], []) + _training_sql(),
        """SELECT t.*, missing_pct_seen < missing_pct AS misses_more FROM training t,
          (SELECT missing_pct AS missing_pct_seen FROM customer_m) c""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest's training rows and their scaled metrics, and which miss more than a table does."""
    found = scaled_training_table(spark)
    scaled = [F.round(F.col("scaled")[i], 9).alias(f"scaled_{name}") for i, name in enumerate(TRAINING)]
    plain = [F.round(name, 9).alias(name) for name in (*TRAINING, "trust_score")]
    seen = analyze_quality(table(spark, sf_dir, "customer")).first().missing_pct
    return found.select("row", *plain, *scaled, (F.lit(seen) < F.round("missing_pct", 9)).alias("misses_more"))


@query(
    "forest_agreement",
    E.with_ctes(
        sum([E.table_metrics(name) for name in SCORED_TABLES], []),
        " UNION ALL ".join(
            f"""SELECT '{name}' AS table_name, missing_pct, duplicate_pct, outlier_pct, CAST(200 AS BIGINT) AS trees,
              0::DOUBLE AS difference FROM {name}_m"""
            for name in SCORED_TABLES
        ),
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the looked-up leaf values are from the model's own prediction, to nine digits."""
    found = tree_agreement(_all_metrics(spark, sf_dir))
    apart = F.abs(F.round(F.col("prediction") - F.col("mean"), 9))
    return found.select("table_name", "missing_pct", "duplicate_pct", "outlier_pct", "trees", apart.alias("difference"))


@query("trust_forest")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_trust_score(_all_metrics(spark, sf_dir), "forest").select(
        "table_name", "trust_score", "std_dev", "confidence_level"
    )


@query(
    "trust_forest_rules",
    "SELECT table_name, true AS score_in_range, true AS spread_in_range, true AS confidence_follows,"
    " true AS importances_sum, true AS near_formula FROM (VALUES "
    + ", ".join(f"('{name}')" for name in SCORED_TABLES)
    + ") t(table_name)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any forest of this kind, though learner and random numbers are Spark's own."""
    metrics = _all_metrics(spark, sf_dir)
    forest = predict_trust_score(metrics, "forest")
    formula = predict_trust_score(metrics, "formula").select(
        "table_name", F.col("trust_score").alias("formula_score")
    )
    # The limits of the confidence levels; at the rounded limit either may stand.
    level = F.when(F.col("std_dev") < 3.5, "High").when(F.col("std_dev") < 7.0, "Medium").otherwise("Low")
    at_limit = F.col("std_dev").isin(3.5, 7.0)
    weights = F.aggregate(F.map_values("importances"), F.lit(0.0), lambda total, weight: total + weight)
    return forest.join(formula, "table_name").select(
        "table_name",
        F.col("trust_score").between(0, 100).alias("score_in_range"),
        F.col("std_dev").between(0, 50).alias("spread_in_range"),
        ((F.col("confidence_level") == level) | at_limit).alias("confidence_follows"),
        ((F.size("importances") == 7) & weights.between(99.9, 100.1)).alias("importances_sum"),
        (F.abs(F.col("trust_score") - F.col("formula_score")) <= 15).alias("near_formula"),
    )


@query("forest_importances")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's weights next to the metrics they weigh, for one table."""
    scored = predict_trust_score(analyze_quality(dirty(spark, sf_dir), KEY), "forest")
    return scored.select("trust_score", F.explode("importances").alias("feature", "importance_pct"))


# ── cleaning ─────────────────────────────────────────────────────────────────────────────


@query("dedup", E.with_ctes(DIRTY_CLEAN, "SELECT * FROM c_u"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _dirty_normalized(spark, sf_dir)
    return distinct_rows(df, df.count(), KEY)


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _dirty_normalized(spark, sf_dir)
    return distinct_rows(df, df.count(), KEY)


@query(
    "numeric_imputation_plan",
    E.with_ctes(
        DIRTY_CLEAN, "SELECT column_name, strategy, filled_count, round(fill_value, 4) AS fill_value FROM c_np"
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = fit_numeric_imputations(_unique(spark, sf_dir), DIRTY_NUMBERS)
    rows = [(p.column, p.strategy, p.filled_count, round(p.fill_value, 4)) for p in plan]
    return spark.createDataFrame(
        rows, "column_name string, strategy string, filled_count bigint, fill_value double"
    )


@query(
    "text_imputation_plan",
    E.with_ctes(DIRTY_CLEAN, "SELECT column_name, strategy, filled_count, fill_value FROM c_tp"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _unique(spark, sf_dir)
    plan = fit_text_imputations(df, df.count(), DIRTY_TEXTS)
    rows = [(p.column, p.strategy, p.filled_count, p.fill_value) for p in plan]
    return spark.createDataFrame(
        rows, "column_name string, strategy string, filled_count bigint, fill_value string"
    )


def _shown_cells(relation: str) -> str:
    columns = [
        f"round(CAST({c} AS DOUBLE), 6) AS {c}" if kind == "n" else c
        for c, kind in DIRTY_KINDS.items()
    ]
    return f"SELECT row_id, {', '.join(columns)} FROM {relation}"


def _cells(df: DataFrame) -> DataFrame:
    columns = [
        F.round(F.col(c).cast("double"), 6).alias(c) if kind == "n" else F.col(c)
        for c, kind in DIRTY_KINDS.items()
    ]
    return df.select(KEY, *columns)


@query("impute", E.with_ctes(DIRTY_CLEAN, _shown_cells("c_i")))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _unique(spark, sf_dir)
    rows, nulls = null_counts(df, KEY)
    plan = fit_imputations(df, rows, {name for name, n in nulls.items() if n}, KEY)
    return _cells(apply_imputations(df, plan))


@query(
    "clip_outliers",
    E.with_ctes(
        DIRTY_CLEAN,
        """SELECT column_name, round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound,
          low_count AS clipped_low, high_count AS clipped_high FROM c_f
          WHERE usable AND low_count + high_count > 0""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _unique(spark, sf_dir)
    rows, nulls = null_counts(df, KEY)
    plan = fit_imputations(df, rows, {name for name, n in nulls.items() if n}, KEY)
    filled = apply_imputations(df, plan)
    clippings, _ = fit_clippings(filled, {name: rows for name in numeric_names(filled, KEY)})
    found = outlier_counts(filled, [entry.fences for entry in clippings])
    return found.select(
        F.col("column").alias("column_name"),
        *_rounded(["lower_bound", "upper_bound"], 6),
        F.col("low_count").alias("clipped_low"),
        F.col("high_count").alias("clipped_high"),
    )


@query("clean_data", E.with_ctes(DIRTY_CLEAN, _shown_cells("c_c")))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(clean_data(dirty(spark, sf_dir), KEY, validate=False).frame)


_AUDIT = """SELECT duplicates_removed, missing_before, missing_after, clipped, no_missing_values,
  no_duplicate_rows FROM {p}_r"""


def _audit(report: DataFrame) -> DataFrame:
    clipped = F.aggregate(
        "outlier_clipping",
        F.lit(0).cast("long"),
        lambda acc, entry: acc + entry["clipped_low"] + entry["clipped_high"],
    )
    return report.select(
        "duplicates_removed", "missing_before", "missing_after", clipped.alias("clipped"), "validation.*"
    )


@query("cleaning_report", E.with_ctes(DIRTY_CLEAN + [E.audit(DIRTY_KINDS, "c")], _AUDIT.format(p="c")))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(clean_data(dirty(spark, sf_dir), KEY).report())


@query("validation", E.with_ctes(GAPS_CLEAN + [E.audit(KINDS["gaps"], "g")], _AUDIT.format(p="g")))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filling gaps makes rows equal here, which is reported and left as it is."""
    return _audit(clean_data(gaps(spark, sf_dir), KEY).report())


# ── corruption ───────────────────────────────────────────────────────────────────────────

MASKED = [("masked", E.masked_cells("dirty", DIRTY_KINDS, FRACTION, SEED))]
MASKED_TABLE = [
    (
        "holes",
        "SELECT row_id, "
        + ", ".join(
            f"CASE WHEN row_id IN (SELECT row_id FROM masked WHERE column_name = '{c}') THEN NULL ELSE {c} END AS {c}"
            for c in DIRTY_KINDS
        )
        + " FROM dirty",
    )
]
ACCURACY = (
    E.source("dirty")
    + MASKED
    + MASKED_TABLE
    + E.cleaning("holes", DIRTY_KINDS, "h")
    + [
        (
            "lookups",
            " UNION ALL ".join(
                f"""SELECT {'true' if kind == 'n' else 'false'} AS is_number,
                  {f'abs(CAST(b.{c} AS DOUBLE) - CAST(a.{c} AS DOUBLE))' if kind == 'n' else '0::DOUBLE'} AS error,
                  {f'abs(CAST(b.{c} AS DOUBLE) - CAST(a.{c} AS DOUBLE)) <= greatest(abs(CAST(a.{c} AS DOUBLE)) * 0.05::DOUBLE, 1e-9::DOUBLE)' if kind == 'n' else f'a.{c} = b.{c}'} AS hit
                FROM masked m JOIN dirty a ON a.row_id = m.row_id LEFT JOIN h_c b ON b.row_id = m.row_id
                WHERE m.column_name = '{c}'"""
                for c, kind in DIRTY_KINDS.items()
            ),
        ),
        (
            "sums",
            """SELECT count(*) AS masked_cells, count(*) FILTER (WHERE is_number) AS numeric_masked,
              count(*) FILTER (WHERE NOT is_number) AS categorical_masked,
              count(*) FILTER (WHERE is_number AND hit) AS hits,
              count(*) FILTER (WHERE NOT is_number AND hit) AS matches,
              coalesce(sum(error) FILTER (WHERE is_number), 0) AS errors FROM lookups""",
        ),
        (
            "accuracy",
            f"""SELECT masked_cells, numeric_masked, categorical_masked,
              {E.pct('hits', 'numeric_masked')} AS numeric_within_5pct_accuracy,
              {E.pct('matches', 'categorical_masked')} AS categorical_exact_match_accuracy,
              round(errors / numeric_masked, 3) AS numeric_mae,
              {E.pct('(hits + matches)', 'masked_cells')} AS overall_imputation_accuracy FROM sums""",
        ),
    ]
)


@query("mask_cells", E.with_ctes(E.source("dirty") + MASKED, "SELECT row_id, column_name FROM masked"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = dirty(spark, sf_dir)
    found = masked_cells(df, fit_masking(df, KEY, FRACTION, SEED))
    return found.withColumnRenamed("column", "column_name")


@query("imputation_accuracy", E.with_ctes(ACCURACY, "SELECT * FROM accuracy"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = imputation_accuracy(dirty(spark, sf_dir), KEY, FRACTION, SEED)
    return found.withColumn("numeric_mae", F.round("numeric_mae", 3))


_ROW_HASH = E.cell_hash("row", SEED)
DUPLICATES = E.source("dirty") + [
    E.unique_rows("dirty", DIRTY_KINDS, "u"),
    (
        "copies",
        f"""SELECT {', '.join(DIRTY_KINDS)} FROM (
          SELECT *, row_number() OVER (ORDER BY {_ROW_HASH}, row_id) AS place, count(*) OVER () AS n FROM u) s
          WHERE place <= least(n, greatest(1, CAST(floor(n * {FRACTION}::DOUBLE) AS BIGINT)))""",
    ),
    (
        "corrupted",
        f"SELECT {', '.join(DIRTY_KINDS)} FROM u UNION ALL SELECT {', '.join(DIRTY_KINDS)} FROM copies",
    ),
    E.normalized("corrupted", DIRTY_KINDS, "cn", False),
    (
        "fixed",
        """SELECT (SELECT count(*) FROM copies) AS injected,
          (SELECT count(*) FROM copies) - greatest(
            (SELECT count(*) FROM (SELECT DISTINCT * FROM cn) d) - (SELECT count(*) FROM u), 0) AS removed""",
    ),
    (
        "duplicate_fix",
        f"""SELECT injected AS injected_duplicates, greatest(removed, 0) AS duplicates_removed,
          {E.pct('greatest(removed, 0)', 'injected')} AS duplicate_fix_accuracy FROM fixed""",
    ),
]


@query("duplicate_fix", E.with_ctes(DUPLICATES, "SELECT * FROM duplicate_fix"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_fix_accuracy(dirty(spark, sf_dir), KEY, FRACTION, SEED)


OUTLIERS = (
    DIRTY_CLEAN
    + [
        ("before_f", E.fence_rows("c_n", DIRTY_NUMBERS)),
        E.normalized("c_c", DIRTY_KINDS, "after_n", False),
        ("after_f", E.fence_rows("after_n", DIRTY_NUMBERS)),
        (
            "outlier_sums",
            """SELECT (SELECT CAST(sum(low_count + high_count) AS BIGINT) FROM before_f WHERE usable) AS b,
              (SELECT CAST(sum(low_count + high_count) AS BIGINT) FROM after_f WHERE usable) AS a""",
        ),
        (
            "outlier_fix",
            f"""SELECT b AS outlier_count_before, a AS outlier_count_after,
              {E.pct('greatest(b - a, 0)', 'b')} AS outlier_reduction_pct FROM outlier_sums""",
        ),
    ]
)


@query("outlier_fix", E.with_ctes(OUTLIERS, "SELECT * FROM outlier_fix"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_fix_effectiveness(dirty(spark, sf_dir), KEY)


_WEIGHTED = (
    "(overall_imputation_accuracy * 0.6::DOUBLE + duplicate_fix_accuracy * 0.25::DOUBLE"
    " + outlier_reduction_pct * 0.15::DOUBLE)"
)


@query(
    "cleaning_score",
    E.with_ctes(
        ACCURACY + DUPLICATES + OUTLIERS,
        f"""SELECT overall_imputation_accuracy, duplicate_fix_accuracy, outlier_reduction_pct,
          {E.rounded(_WEIGHTED, 2)} AS overall_cleaning_accuracy_score
          FROM accuracy, duplicate_fix, outlier_fix""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate_cleaning_accuracy(dirty(spark, sf_dir), KEY, FRACTION, FRACTION, SEED)
    return found.select(
        "imputation_accuracy.overall_imputation_accuracy",
        "duplicate_fix.duplicate_fix_accuracy",
        "outlier_fix.outlier_reduction_pct",
        "evaluation.overall_cleaning_accuracy_score",
    )


# ── full runs, history and views of runs ─────────────────────────────────────────────────

RUN = (
    DIRTY_CLEAN
    + [E.audit(DIRTY_KINDS, "c")]
    + E.metrics("dirty", DIRTY_KINDS, True, "before_m")
    + E.metrics("c_c", DIRTY_KINDS, True, "after_m")
    + [E.scored("before_m"), E.scored("after_m")]
)


def _dirty_run(spark: SparkSession, sf_dir: str, **places: str) -> QualityRun:
    return run_quality(
        dirty(spark, sf_dir),
        "dirty orders.csv",
        KEY,
        scorer="formula",
        created_at=MOMENT,
        **places,
    )


_SIDES = [(side, name) for side in ("before", "after") for name in (*E.METRICS, "trust_score")]


@query(
    "quality_run",
    E.with_ctes(
        RUN,
        "SELECT 'SUCCESS' AS status, 'dirty orders.csv' AS filename, b.trust_score < 95 AS was_cleaned, "
        "duplicates_removed, missing_before, missing_after, "
        + ", ".join(f"{side[0]}.{name} AS {side}_{name}" for side, name in _SIDES)
        + " FROM before_m_s b, after_m_s a, c_r",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = F.col("cleaning_report")
    return _dirty_run(spark, sf_dir).result.select(
        "status",
        "filename",
        "was_cleaned",
        report.duplicates_removed.alias("duplicates_removed"),
        report.missing_before.alias("missing_before"),
        report.missing_after.alias("missing_after"),
        *[F.col(f"{side}.{name}").alias(f"{side}_{name}") for side, name in _SIDES],
    )


_RECORDED = ("total_rows", "missing_pct", "duplicate_pct", "outlier_pct", "trust_score")
_CLEAN_TABLES = ("customer", "events")


def _history_sql() -> list[tuple[str, str]]:
    """The dirty table is cleaned; the others score above the threshold and stay."""
    ctes = list(RUN)
    rows = []
    for place, name in enumerate(("dirty", *_CLEAN_TABLES), 1):
        before, after = "before_m_s", "after_m_s"
        if name != "dirty":
            ctes += E.table_metrics(name) + [E.scored(f"{name}_m")]
            before = after = f"{name}_m_s"
        columns = [
            f"{side[0]}.{column} AS {side}_{column}"
            for side in ("before", "after")
            for column in _RECORDED
        ]
        rows.append(
            f"SELECT {place} AS id, '{name}.csv' AS filename, '2024-01-01 12:0{place}:00' AS upload_time, "
            f"{', '.join(columns)}, b.trust_score < 95 AS was_cleaned, 'High' AS confidence_level "
            f"FROM {before} b, {after} a"
        )
    return ctes + [("history", " UNION ALL ".join(rows))]


HISTORY = _history_sql()


def _history_path(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "history")
    for place, name in enumerate(("dirty", *_CLEAN_TABLES), 1):
        df, key = _source(spark, sf_dir, name)
        run_quality(
            df,
            f"{name}.csv",
            key,
            scorer="formula",
            history=path,
            run_key=name,
            created_at=MOMENT + dt.timedelta(minutes=place),
        )
    return path


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_history(spark, _history_path(spark, sf_dir))


@query("run_history", E.with_ctes(HISTORY, "SELECT * FROM history ORDER BY upload_time DESC, id DESC LIMIT 50"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(latest_runs(_history(spark, sf_dir)))


@query("run_by_id", E.with_ctes(HISTORY, "SELECT * FROM history WHERE id = 2"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(find_run(spark, _history_path(spark, sf_dir), 2))


@query(
    "run_improvement",
    E.with_ctes(
        HISTORY,
        f"""SELECT id, {E.rounded('(after_trust_score - before_trust_score)', 1, up=True)} AS improvement,
          after_trust_score >= 95 AS above_threshold FROM history""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_improvement(_history(spark, sf_dir)).select("id", "improvement", "above_threshold")


_IMPROVABLE = [
    ("missing_pct", "Missing values"),
    ("duplicate_pct", "Duplicate rows"),
    ("outlier_pct", "Outliers (IQR)"),
    ("type_inconsistency_pct", "Type inconsistency"),
    ("null_col_ratio", "Null columns"),
    ("constant_col_ratio", "Constant columns"),
]


@query(
    "cleaning_summary",
    E.with_ctes(
        RUN
        + [
            (
                "changes",
                " UNION ALL ".join(
                    f"SELECT '{metric}' AS metric, '{label}' AS label, b.{metric} AS before, "
                    f"a.{metric} AS after, b.{metric} - a.{metric} AS change FROM before_m b, after_m a"
                    for metric, label in _IMPROVABLE
                ),
            )
        ],
        f"""SELECT metric, label, before, after, {E.rounded('change', 1, up=True)} AS fixed FROM changes
          WHERE {E.rounded('change', 1, up=True)} > 0.1::DOUBLE ORDER BY fixed DESC""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning_summary(_dirty_run(spark, sf_dir).result)


_TREND_METRICS = ("missing_pct", "duplicate_pct", "outlier_pct")


@query(
    "metric_trend",
    E.with_ctes(
        RUN
        + [
            (
                "changes",
                " UNION ALL ".join(
                    f"SELECT '{m}' AS metric, a.{m} - b.{m} AS change, b.{m} AS old, a.{m} AS new "
                    "FROM before_m b, after_m a"
                    for m in _TREND_METRICS
                ),
            ),
            (
                "tenths",
                f"""SELECT metric, change, {E.rounded('abs(change)', 1, up=True)} AS size,
                  {E.rounded('change', 1, up=True)} AS signed,
                  {E.rounded('new', 1, up=True)} AS shown FROM changes""",
            ),
        ],
        """SELECT metric, CASE WHEN change < -0.5 THEN 'down' WHEN change > 0.5 THEN 'up' ELSE 'flat' END AS direction,
          CASE WHEN change < -0.5 THEN concat('−', printf('%.1f', size), '%')
               WHEN change > 0.5 THEN concat('+', printf('%.1f', size), '%') ELSE '±0%' END AS label,
          concat(printf('%.1f', shown), '%') AS pct,
          concat(CASE WHEN signed > 0 THEN '+' ELSE '' END, printf('%.1f', signed), '%') AS delta
          FROM tenths""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _dirty_run(spark, sf_dir).result
    rows = F.array(
        *[
            F.struct(
                F.lit(metric).alias("metric"),
                F.col(f"before.{metric}").alias("old"),
                F.col(f"after.{metric}").alias("new"),
            )
            for metric in _TREND_METRICS
        ]
    )
    changes = result.select(F.inline(rows))
    return changes.select(
        "metric",
        metric_trend(F.col("old"), F.col("new")).alias("trend"),
        percent_text(F.col("new")).alias("pct"),
        delta_text(F.col("old"), F.col("new")).alias("delta"),
    ).select("metric", "trend.direction", "trend.label", "pct", "delta")


@query(
    "cleaning_actions",
    E.with_ctes(
        RUN,
        """SELECT 1 AS place, concat('Missing values fixed: ', format('{:,}', missing_before - missing_after)) AS action,
          duplicates_removed AS rows_removed FROM c_r
        UNION ALL SELECT 2, concat('Duplicate rows removed: ', format('{:,}', duplicates_removed)), duplicates_removed FROM c_r
        UNION ALL SELECT 3, concat('Outlier values clipped to IQR bounds: ', format('{:,}', clipped)), duplicates_removed FROM c_r""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = cleaning_actions(_dirty_run(spark, sf_dir).result)
    return result.select(
        F.posexplode("actions").alias("place", "action"), rows_removed().alias("rows_removed")
    ).withColumn("place", F.col("place") + 1)


@query(
    "imputation_preview",
    E.with_ctes(
        DIRTY_CLEAN
        + [
            (
                "plan",
                "SELECT column_name, strategy, filled_count FROM c_np "
                "UNION ALL SELECT column_name, strategy, filled_count FROM c_tp",
            ),
            (
                "placed",
                "SELECT *, CASE column_name "
                + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(DIRTY_KINDS))
                + " END AS position FROM plan",
            ),
        ],
        """SELECT column_name, strategy, filled_count FROM placed
          QUALIFY row_number() OVER (ORDER BY position) <= 8""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _dirty_run(spark, sf_dir).result
    shown_rows = result.select(F.explode(imputation_preview()).alias("entry"))
    return shown_rows.select(
        F.col("entry.column").alias("column_name"), "entry.strategy", "entry.filled_count"
    )


_LINES = [
    ("Rows", "total_rows"),
    ("Missing %", "missing_pct"),
    ("Duplicate %", "duplicate_pct"),
    ("Outlier %", "outlier_pct"),
    ("Type inconsistency %", "type_inconsistency_pct"),
    ("Null column ratio %", "null_col_ratio"),
    ("Constant column ratio %", "constant_col_ratio"),
    ("Average skewness", "avg_skewness"),
]


def _report_sql() -> str:
    def metrics(side: str) -> list[str]:
        return [f"concat('{label}: ', {side}.{name})" for label, name in _LINES]

    plan = " UNION ALL ".join(
        f"SELECT {place} AS position, column_name, strategy, filled_count FROM "
        f"{'c_np' if kind == 'n' else 'c_tp'} WHERE column_name = '{c}'"
        for place, (c, kind) in enumerate(DIRTY_KINDS.items())
        if kind != "o"
    )
    fills = (
        "(SELECT string_agg(concat('- Column ', column_name, ' used ', strategy, ' (', filled_count,"
        " ' values).'), chr(10) ORDER BY position) FROM (SELECT * FROM report_plan ORDER BY position LIMIT 6) p)"
    )
    flag = "CASE WHEN {} THEN 'True' ELSE 'False' END"
    lines = [
        "'Data Quality Cleaning Report'",
        "'Created At: 2024-01-01 12:00:00'",
        "'Run ID: 1'",
        "'Dataset Name: dirty orders.csv'",
        "'Trust Threshold: 95.0'",
        "'Was Cleaned: True'",
        "''",
        "'Trust Score Summary'",
        "concat('Before: ', printf('%.2f', b.trust_score))",
        "concat('After: ', printf('%.2f', a.trust_score))",
        "concat('Change: ', printf('%+.2f', a.trust_score - b.trust_score))",
        "'Confidence Level: High'",
        "''",
        "'Key Metrics Before'",
        *metrics("b"),
        "''",
        "'Key Metrics After'",
        *metrics("a"),
        "''",
        "'Cleaning Actions'",
        "concat('- Missing values reduced from ', missing_before, ' to ', missing_after, '.')",
        "concat('- Removed ', duplicates_removed, ' duplicate rows.')",
        "concat('- Clipped ', clipped, ' outlier values to IQR bounds.')",
        fills,
        "''",
        "'Structured Cleaning Details'",
        "concat('Duplicates Removed: ', duplicates_removed)",
        "concat('Missing Before: ', missing_before)",
        "concat('Missing After: ', missing_after)",
        f"concat('Validation No Missing Values: ', {flag.format('no_missing_values')})",
        f"concat('Validation No Duplicate Rows: ', {flag.format('no_duplicate_rows')})",
        "''",
        "'Answering Hint'",
        "'Use this report to explain why trust score changed, which cleaning actions were applied, "
        "and what issues remained after processing.'",
    ]
    body = ",\n".join(lines)
    return E.with_ctes(
        RUN + [("report_plan", plan)],
        f"SELECT 'run_1_dirty_orders' AS doc_id, concat_ws(chr(10), {body}) AS report "
        "FROM before_m_s b, after_m_s a, c_r",
    )


@query("run_report", _report_sql())
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "reports")
    _dirty_run(spark, sf_dir, history=new_path(spark, "history"), reports=folder)
    return read_reports(spark, folder).select("doc_id", F.col("text").alias("report"))


# ── reports, index and retrieval ─────────────────────────────────────────────────────────

REPORTS = E.source("reports")
METADATA = REPORTS + [
    (
        "index_rows",
        r"""SELECT doc_id,
          coalesce(TRY_CAST(regexp_extract(text, '(?m)^Run ID:[ ]*([+-]?[0-9]+)[ ]*$', 1) AS INTEGER), -1) AS run_id,
          CASE WHEN regexp_matches(text, '(?m)^Dataset Name:')
               THEN regexp_extract(text, '(?m)^Dataset Name:[ ]*(.*)$', 1)
               ELSE regexp_extract(report_path, '([^/]*)\.txt$', 1) END AS filename,
          report_path, text FROM reports""",
    )
]


@query(
    "report_metadata",
    E.with_ctes(METADATA, "SELECT doc_id, run_id, filename, report_path FROM index_rows"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_metadata(report_texts(spark, sf_dir)).drop("text")


@query(
    "index_upsert",
    E.with_ctes(
        METADATA,
        """SELECT doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS version,
          run_id, filename FROM index_rows
        UNION ALL SELECT concat(doc_id, '-new'), 2, run_id, filename FROM index_rows
          WHERE CAST(doc_id AS BIGINT) % 5 = 0""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = report_metadata(report_texts(spark, sf_dir)).withColumn("version", F.lit(1))
    number = F.col("doc_id").cast("bigint")
    again = index.where(number % 3 == 0).withColumn("version", F.lit(2))
    fresh = (
        index.where(number % 5 == 0)
        .withColumn("version", F.lit(2))
        .withColumn("doc_id", F.concat("doc_id", F.lit("-new")))
    )
    found = upsert_index(index, again.unionByName(fresh), "version")
    return found.select("doc_id", "version", "run_id", "filename")


_VECTOR_SQL = f"""
WITH places AS (
  SELECT vec_id, label, unnest(embedding) AS value, generate_subscripts(embedding, 1) AS place FROM embeddings),
centroids AS (SELECT label, place, avg(CAST(value AS DOUBLE)) AS mean FROM places GROUP BY label, place),
lengths AS (SELECT vec_id, sqrt(sum(CAST(value AS DOUBLE) * CAST(value AS DOUBLE))) AS size FROM places GROUP BY vec_id),
centroid_lengths AS (SELECT label, sqrt(sum(mean * mean)) AS size FROM centroids GROUP BY label),
dots AS (SELECT c.label, p.vec_id, sum(c.mean * CAST(p.value AS DOUBLE)) AS dot
  FROM centroids c JOIN places p ON p.place = c.place GROUP BY c.label, p.vec_id),
cosines AS (SELECT d.label AS question_id, d.vec_id AS doc_id, round(d.dot / (q.size * l.size), 6) AS score
  FROM dots d JOIN lengths l ON l.vec_id = d.vec_id JOIN centroid_lengths q ON q.label = d.label)
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
  doc_id, score FROM cosines
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) <= 5"""


@query("vector_topk", _VECTOR_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors closest to the centre of each label."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label"
    )
    return vector_topk(vectors, group_centroids(vectors, "label"))


@query("vector_topk_indexed", _VECTOR_SQL)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index of random-projection buckets, with exact search."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label"
    )
    path = new_path(spark, "vector_index")
    build_vector_index(vectors, path)
    return search_vectors(path, group_centroids(vectors, "label")).matches


@query(
    "vector_topk_nonfinite",
    _VECTOR_SQL.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 7 <> 0)"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every seventh vector holds an infinity: these score 0 and hide no other."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label"
    )
    whole = vectors.where("doc_id % 7 <> 0")
    broken = F.expr(
        "if(doc_id % 7 = 0, transform(vector, (v, i) -> if(i = 3, cast('Infinity' as float), v)), vector)"
    )
    return vector_topk(vectors.withColumn("vector", broken), group_centroids(whole, "label"))


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("doc_id").cast("int").alias("run_id"),
        F.col("source").alias("filename"),
        F.concat(F.lit("reports/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("report_path"),
        "text",
    )


def _questions(spark: SparkSession, sf_dir: str, restricted: bool) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    number = F.col("item_id")
    run_id = F.when(number % 4 != 0, (number * 37).cast("int")) if restricted else F.lit(None)
    filename = F.when(number % 4 != 3, F.concat(F.lit("src"), (number % 20).cast("string")))
    return items.select(
        number.alias("question_id"),
        F.col("text").alias("question"),
        run_id.cast("int").alias("run_id"),
        (filename if restricted else F.lit(None).cast("string")).alias("filename"),
    )


def _topk_ctes(restricted: bool) -> list[tuple[str, str]]:
    run_id = "CASE WHEN item_id % 4 <> 0 THEN item_id * 37 END" if restricted else "CAST(NULL AS BIGINT)"
    filename = (
        "CASE WHEN item_id % 4 <> 3 THEN concat('src', item_id % 20) END"
        if restricted
        else "CAST(NULL AS VARCHAR)"
    )
    word = r"[\p{L}\p{N}]+"
    return [
        (
            "asked",
            f"""SELECT item_id AS question_id, text AS question, {run_id} AS run_id, {filename} AS filename,
              CASE WHEN {run_id} IS NULL THEN 'all'
                   WHEN {run_id} IN (SELECT doc_id FROM documents) THEN 'run'
                   WHEN coalesce({filename}, '') <> '' THEN 'file' ELSE 'none' END AS scope FROM benchmark""",
        ),
        (
            "dt",
            f"""SELECT doc_id, term, 1 + ln(count(*)) AS raw FROM (
              SELECT doc_id, unnest(regexp_extract_all(lower(text), '{word}')) AS term FROM documents) s
              GROUP BY doc_id, term""",
        ),
        ("dl", "SELECT doc_id, sqrt(sum(raw * raw)) AS size FROM dt GROUP BY doc_id"),
        ("df", "SELECT term, count(*) AS df FROM dt GROUP BY term"),
        (
            "qt",
            f"""SELECT q.question_id, q.term, (1 + ln(q.tf)) * ln(CAST((SELECT count(*) FROM documents) + 1 AS DOUBLE)
                / (coalesce(df.df, 0) + 1)) AS raw
              FROM (SELECT question_id, term, count(*) AS tf FROM (
                SELECT question_id, unnest(regexp_extract_all(lower(question), '{word}')) AS term FROM asked) s
                GROUP BY question_id, term) q LEFT JOIN df ON df.term = q.term""",
        ),
        ("ql", "SELECT question_id, sqrt(sum(raw * raw)) AS size FROM qt GROUP BY question_id"),
        (
            "dots",
            """SELECT qt.question_id, dt.doc_id, sum(qt.raw / ql.size * dt.raw / dl.size) AS score
              FROM qt JOIN ql ON ql.question_id = qt.question_id JOIN dt ON dt.term = qt.term
              JOIN dl ON dl.doc_id = dt.doc_id GROUP BY qt.question_id, dt.doc_id""",
        ),
        (
            "visible",
            """SELECT a.question_id, d.doc_id FROM asked a JOIN documents d
              ON a.scope = 'all' OR (a.scope = 'run' AND d.doc_id = a.run_id)
                OR (a.scope = 'file' AND d.source = a.filename)""",
        ),
        (
            "ranked",
            """SELECT v.question_id, v.doc_id, round(coalesce(s.score, 0), 6) AS score FROM visible v
              LEFT JOIN dots s ON s.question_id = v.question_id AND s.doc_id = v.doc_id""",
        ),
        (
            "best",
            """SELECT question_id,
              CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
              doc_id, score FROM ranked
              QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) <= 5""",
        ),
    ]


@query("text_topk_postings", E.with_ctes(_topk_ctes(False), "SELECT * FROM best"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches from stored postings, of which only the promising blocks are read."""
    path = new_path(spark, "postings")
    build_postings(_index(spark, sf_dir), path)
    return postings_topk(spark, path, _questions(spark, sf_dir, False)).matches


@query("text_topk", E.with_ctes(_topk_ctes(False), "SELECT * FROM best"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_topk(_index(spark, sf_dir), _questions(spark, sf_dir, False))


@query("topk_fallback", E.with_ctes(_topk_ctes(True), "SELECT * FROM best"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_topk(_index(spark, sf_dir), _questions(spark, sf_dir, True))


@query(
    "context",
    E.with_ctes(
        _topk_ctes(True),
        """SELECT a.question_id, coalesce(c.context, 'No matching reports were found.') AS context,
          coalesce(c.sources, '') AS sources
          FROM asked a LEFT JOIN (
            SELECT b.question_id, string_agg(d.text, chr(10) || chr(10) ORDER BY b.rank) AS context,
              string_agg(concat(d.doc_id, ':', d.source, ':reports/', d.doc_id, '.txt'), ',' ORDER BY b.rank) AS sources
            FROM best b JOIN documents d ON d.doc_id = b.doc_id GROUP BY b.question_id) c
          ON c.question_id = a.question_id""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, questions = _index(spark, sf_dir), _questions(spark, sf_dir, True)
    found = answer_context(questions, index)
    listed = F.transform(
        "sources",
        lambda s: F.concat_ws(":", s["run_id"].cast("string"), s["filename"], s["report_path"]),
    )
    return found.select("question_id", "context", F.array_join(listed, ",").alias("sources"))


# ── files and streams ────────────────────────────────────────────────────────────────────


@query(
    "csv_roundtrip",
    E.with_ctes(DIRTY_CLEAN, _shown_cells("c_c").replace("row_id, ", "", 1)),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned table exported as CSV and read back with inferred types."""
    frame = clean_data(dirty(spark, sf_dir), KEY, validate=False).frame.drop(KEY)
    path = export_table(frame, new_path(spark, "exports"), 1, "csv")
    return _cells(read_csv(spark, path).withColumn(KEY, F.lit(0))).drop(KEY)


@query(
    "csv_types",
    """SELECT doc_id, CASE WHEN text IN ('', 'nan') THEN NULL ELSE text END AS text, lang, source, n_chars
      FROM documents""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and line breaks through a CSV file."""
    path = new_path(spark, "texts") + ".csv"
    writer = table(spark, sf_dir, "documents").write.option("header", True)
    # Line ends inside quotes are kept as they are.
    writer.option("escape", '"').option("quoteAll", True).csv(path)
    return read_csv(spark, path, multiline=True)


@query(
    "result_json",
    E.with_ctes(RUN, "SELECT total_rows, duplicate_count, trust_score FROM before_m_s"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "result") + ".json"
    export_json(_dirty_run(spark, sf_dir).result, path)
    return read_table(spark, path).select(
        "before.total_rows", "before.duplicate_count", "before.trust_score"
    )


def _file_sql() -> list[tuple[str, str]]:
    """The dirty table in three files, each measured, cleaned and measured again."""
    ctes, rows = list(E.source("dirty")), []
    for part in range(FILES):
        name = f"d{part}"
        ctes += [(name, f"SELECT * FROM dirty WHERE o_orderkey % {FILES} = {part}")]
        ctes += E.cleaning(name, DIRTY_KINDS, f"k{part}") + [E.audit(DIRTY_KINDS, f"k{part}")]
        for side, relation in (("before", name), ("after", f"k{part}_c")):
            ctes += E.metrics(relation, DIRTY_KINDS, True, f"{side}{part}") + [E.scored(f"{side}{part}")]
        columns = [f"{s}.{c} AS {t}_{c}" for s, t in (("b", "before"), ("a", "after")) for c in _RECORDED]
        rows.append(
            f"""SELECT {part + 1} AS id, 'dirty_{part}.parquet' AS filename, b.trust_score < 95 AS was_cleaned,
              {", ".join(columns)}, duplicates_removed, missing_before, missing_after, true AS reported,
              a.total_rows AS exported_rows FROM before{part}_s b, after{part}_s a, k{part}_r"""
        )
    return ctes + [("runs", " UNION ALL ".join(rows))]


FILES = 3


@query("stream_ingest", E.with_ctes(_file_sql(), "SELECT * FROM runs"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty files that arrive in a folder, all in one micro-batch; what was recorded of each run."""
    whole = dirty(spark, sf_dir)
    places = {name: new_path(spark, f"stream-{name}") for name in ("files", "history", "state", "reports", "out", "index")}
    land(whole.withColumn("part", F.col("o_orderkey") % FILES), "part", places["files"], "dirty")
    ingest(
        landing_stream(spark, places["files"], whole.schema), "orders", places["history"], places["state"],
        scorer="formula", key=KEY, created_at=MOMENT, exports=places["out"], reports=places["reports"],
        index=places["index"],
    ).awaitTermination()
    runs = read_history(spark, places["history"]).drop("upload_time", "confidence_level")
    # What the report texts and exported tables say of the same runs.
    text = F.col("text")

    def told(label: str) -> Column:
        return F.regexp_extract(text, rf"(?m)^{label}: (\d+)$", 1).cast("bigint")

    reports = read_reports(spark, places["reports"]).select(
        F.regexp_extract("doc_id", r"^run_(\d+)_dirty_", 1).cast("int").alias("id"),
        told("Duplicates Removed").alias("duplicates_removed"),
        told("Missing Before").alias("missing_before"),
        told("Missing After").alias("missing_after"),
        text.alias("report"),
    )
    index = read_index(spark, places["index"]).select(F.col("run_id").alias("id"), F.col("text").alias("indexed"))
    exported = spark.read.parquet(places["out"]).groupBy("export").agg(F.count("*").alias("exported_rows"))
    exported = exported.withColumn("id", F.regexp_extract("export", r"cleaned_(\d+)", 1).cast("int")).drop("export")
    joined = runs.join(reports, "id").join(index, "id").join(exported, "id")
    return joined.withColumn("reported", F.col("report") == F.col("indexed")).drop("report", "indexed")


PARTS = 55
_PAGED = "o_orderkey, o_totalprice, o_orderpriority"
HISTORY_PAGE = [
    ("f", f"SELECT o_orderkey % {PARTS} AS part, {_PAGED} FROM orders"),
    (
        "n",
        "SELECT part, 1 AS place, CAST(o_orderkey AS DOUBLE) AS v FROM f "
        "UNION ALL SELECT part, 2, CAST(o_totalprice AS DOUBLE) FROM f",
    ),
    (
        "q",
        f"""SELECT part, place, n, q1 - 1.5::DOUBLE * (q3 - q1) AS lower_bound, q3 + 1.5::DOUBLE * (q3 - q1) AS upper_bound,
          skew FROM (SELECT part, place, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
            {E.skew("v")} AS skew FROM n GROUP BY part, place) s WHERE n >= 4 AND q3 - q1 <> 0""",
    ),
    (
        "o",
        """SELECT part, count(*) FILTER (WHERE v < lower_bound OR v > upper_bound) AS outliers, count(v) AS cells
          FROM n JOIN q USING (part, place) GROUP BY part""",
    ),
    ("s", "SELECT part, avg(abs(skew)) AS mean_skew FROM q GROUP BY part"),
    (
        "a",
        f"""SELECT part, count(*) AS total_rows, count(*) - count(DISTINCT o_orderkey) AS copies,
          CASE WHEN min(o_orderpriority) = max(o_orderpriority) THEN 1 ELSE 0 END
            + CASE WHEN min(o_orderkey) = max(o_orderkey) THEN 1 ELSE 0 END
            + CASE WHEN min(o_totalprice) = max(o_totalprice) THEN 1 ELSE 0 END AS constants FROM f GROUP BY part""",
    ),
    (
        "m",
        f"""SELECT part, total_rows, 0::DOUBLE AS missing_pct, {E.pct("copies", "total_rows")} AS duplicate_pct,
          {E.pct("coalesce(outliers, 0)", "coalesce(cells, 0)")} AS outlier_pct, 0::DOUBLE AS type_inconsistency_pct,
          0::DOUBLE AS null_col_ratio, {E.pct("constants", "3")} AS constant_col_ratio,
          {E.rounded("coalesce(mean_skew, 0)", 3)} AS avg_skewness
          FROM a LEFT JOIN o USING (part) LEFT JOIN s USING (part)""",
    ),
    E.scored("m"),
    (
        "numbered",
        "SELECT *, CAST(row_number() OVER (ORDER BY part) AS INTEGER) AS id FROM m_s",
    ),
]


@query(
    "history_page",
    E.with_ctes(
        HISTORY_PAGE,
        "SELECT id, 'orders_' || lpad(CAST(part AS VARCHAR), 2, '0') || '.csv' AS filename, false AS was_cleaned, "
        + ", ".join(f"{c} AS {side}_{c}" for side in ("before", "after") for c in _RECORDED)
        + " FROM numbered ORDER BY id DESC LIMIT 50",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of a history of 55 runs, measured and recorded as one batch."""
    part = F.lpad((F.col("o_orderkey") % PARTS).cast("string"), 2, "0")
    named = F.concat(F.lit("landing/orders_"), part, F.lit(".csv")).alias(FILE)
    orders = table(spark, sf_dir, "orders").select(*_PAGED.split(", "), named)
    path = new_path(spark, "paged-history")
    run_quality_batch(orders, scorer="formula", threshold=0.0, history=path, created_at=MOMENT)
    return latest_runs(read_history(spark, path)).drop("upload_time", "confidence_level")


@query(
    "index_stored",
    E.with_ctes(
        METADATA,
        """SELECT doc_id, CASE WHEN CAST(doc_id AS BIGINT) % 3 = 0 THEN 4 ELSE 1 END::BIGINT AS version,
          CASE WHEN CAST(doc_id AS BIGINT) % 3 = 0 THEN filename || ' 4' ELSE filename END AS filename, run_id
          FROM index_rows
        UNION ALL SELECT concat(doc_id, '-new'), 2, filename, run_id FROM index_rows
          WHERE CAST(doc_id AS BIGINT) % 5 = 0""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index after an upsert with three changes to some documents, read anew."""
    index = report_metadata(report_texts(spark, sf_dir))
    number, path = F.col("doc_id").cast("bigint"), new_path(spark, "index")

    def change(df: DataFrame, version: int) -> DataFrame:
        name = F.concat("filename", F.lit(f" {version}")) if version > 2 else F.col("filename")
        return df.withColumn("version", F.lit(version).cast("long")).withColumn("filename", name)

    upsert_reports(change(index, 1), path)
    again = index.where(number % 3 == 0)
    fresh = index.where(number % 5 == 0).withColumn("doc_id", F.concat("doc_id", F.lit("-new")))
    changes = [change(again, 3), change(again, 4), change(again, 2), change(fresh, 2)]
    upsert_reports(reduce(DataFrame.unionByName, changes), path)
    return read_index(spark.newSession(), path).select("doc_id", "version", "filename", "run_id")
