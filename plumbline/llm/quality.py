"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text.

Tokens are lower-case runs of letters and digits, or of other visible characters; one- and
two-token n-grams are hashed into a fixed number of buckets.  Two multinomials over the buckets
are counted, one from trusted documents and one from the whole corpus.  A document's score is
the mean log ratio of its n-grams; every document is judged against one fixed threshold.

All steps are column expressions; the only aggregation is one count per bucket and task.  Texts
are split once: what is counted in a text alone is written with its n-grams, from which both
multinomials are counted and every document is scored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.storage import settle

BUCKETS = 1 << 14
# Trusted documents counted at most: those whose ids have the smallest hashes.
TRUSTED_SAMPLE = 50_000
# Mean log ratio under which a document is rejected.
THRESHOLD = -0.55
SMOOTHING = 1.0

# Words, white space and symbols of the base rules.
_SPACES = r"[\x20\x09-\x0D]+"
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def _token_hashes(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(_TOKENS), F.lit(0))
    return F.transform(found, lambda token: F.xxhash64(token))


def _grams(hashes: str, buckets: int) -> Column:
    """Bucket of every token and of every pair of neighbours."""
    pairs = (
        f"if(size({hashes}) < 2, array(), transform(sequence(1, size({hashes}) - 1),"
        f" i -> cast(pmod(xxhash64(slice({hashes}, i, 2)), {buckets}) as int)))"
    )
    return F.expr(
        f"concat(transform({hashes}, h -> cast(pmod(h, {buckets}) as int)), {pairs})"
    )


def count_grams(texts: DataFrame, buckets: int = BUCKETS) -> dict[int, int]:
    """N-grams per bucket of the column ``text``; at most ``buckets`` numbers."""
    hashed = texts.select(_token_hashes(F.coalesce("text", F.lit(""))).alias("h"))
    return _count(hashed.select(F.explode(_grams("h", buckets)).alias("bucket")))


def _count(grams: DataFrame) -> dict[int, int]:
    return {row["bucket"]: row["n"] for row in grams.groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def log_ratios(trusted: dict[int, int], raw: dict[int, int], buckets: int = BUCKETS) -> list[float]:
    """Smoothed log ratio per bucket; all zero where nothing is trusted."""
    if not trusted:
        return [0.0] * buckets
    total, whole = sum(trusted.values()), sum(raw.values())
    return [
        round(
            math.log((trusted.get(b, 0) + SMOOTHING) / (total + SMOOTHING * buckets))
            - math.log((raw.get(b, 0) + SMOOTHING) / (whole + SMOOTHING * buckets)),
            6,
        )
        for b in range(buckets)
    ]


def fit_quality(
    docs: DataFrame,
    trusted: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
    sample: int = TRUSTED_SAMPLE,
) -> list[float]:
    """Log ratios from the texts of the ids in ``trusted`` and from all texts.

    The raw counts cover every document.  Of the trusted ids, at most ``sample`` are used, a bound
    that also bounds what is broadcast."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    chosen = _chosen(trusted, id_column, sample)
    good = count_grams(texts.join(F.broadcast(chosen), "id", "left_semi"), buckets)
    return log_ratios(good, count_grams(texts, buckets), buckets)


def _chosen(trusted: DataFrame, id_column: str, sample: int) -> DataFrame:
    """At most ``sample`` ids."""
    ids = trusted.select(F.col(id_column).alias("id")).where("id is not null").distinct()
    return ids.orderBy(F.xxhash64("id"), "id").limit(sample)


def assess(
    docs: DataFrame,
    trusted: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int = BUCKETS,
    sample: int = TRUSTED_SAMPLE,
    threshold: float = THRESHOLD,
    name: str = "quality",
    columns: list[str] | None = None,
) -> DataFrame:
    """``judge(docs, fit_quality(docs, trusted))``, with the texts split once; of other columns only
    ``columns`` are kept, all if none are given."""
    kept = [c for c in (docs.columns if columns is None else columns) if c != name]
    described = settle(_describe(docs, kept, text_column, buckets, id_column), "described-texts", "zstd")
    grams = F.explode("__grams").alias("bucket")
    chosen = F.broadcast(_chosen(trusted, id_column, sample))
    named = described.select(F.col("__id").alias("id"), "__grams")
    good = _count(named.join(chosen, "id", "left_semi").select(grams))
    ratios = log_ratios(good, _count(described.select(grams)), buckets)
    return _verdict(described, kept, ratios, threshold, name)


def judge(
    docs: DataFrame,
    ratios: list[float],
    text_column: str = "text",
    threshold: float = THRESHOLD,
    name: str = "quality",
) -> DataFrame:
    """``docs`` with a struct column ``name``: the base counts, ``base_failed``, ``score`` and
    ``kept``.  A column of that name is replaced, all others stay as they are.

    A null text counts as empty; a text without n-grams scores 0.  Equal texts get equal
    verdicts."""
    columns = [c for c in docs.columns if c != name]
    return _verdict(_describe(docs, columns, text_column, len(ratios)), columns, ratios, threshold, name)


def _describe(
    docs: DataFrame, columns: list[str], text_column: str, buckets: int, id_column: str | None = None
) -> DataFrame:
    """``columns``, the counts in each text alone, and its n-grams' buckets."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, _SPACES), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_SPACE)) != "")
    # The id has a name of its own: it may be a column that is not kept.
    ident = [F.col(f"`{id_column}`").alias("__id")] if id_column else []
    first = docs.select(
        *[F.col(f"`{c}`") for c in columns],
        *ident,
        F.length(text).alias("__all"),
        F.length(F.translate(text, _SYMBOLS, "")).alias("__plain"),
        words.alias("__words"),
        lines.alias("__lines"),
        _token_hashes(text).alias("__tokens"),
    )
    kept = [F.col(f"`{c}`") for c in columns] + [F.col("__id")] * len(ident)
    second = first.select(
        *kept,
        F.size("__words").cast("long").alias("__n"),
        F.length(F.array_join("__words", "")).cast("long").alias("__chars"),
        (F.col("__all") - F.col("__plain")).cast("long").alias("__symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("__dups"),
        F.transform("__words", lambda word: F.xxhash64(word)).alias("__hashes"),
        _grams("__tokens", buckets).alias("__grams"),
    )
    third = second.select(
        *kept, "__n", "__chars", "__symbols", "__dups",
        F.expr(
            "if(size(__hashes) < 5, array(), transform(sequence(1, size(__hashes) - 4),"
            " i -> xxhash64(slice(__hashes, i, 5))))"
        ).alias("__windows"),
        "__grams",
    )
    # Only texts that repeat a window are sorted.
    fourth = third.withColumn(
        "__sorted",
        F.expr(
            "if(size(array_distinct(__windows)) < size(__windows),"
            " array_sort(transform(__windows, (h, i) -> named_struct('h', h, 'i', i))), null)"
        ),
    )
    fifth = fourth.withColumn(
        "__places",
        F.expr(
            "array_sort(filter(transform(__sorted, (w, j) -> if(get(__sorted, j - 1).h <=> w.h"
            " or get(__sorted, j + 1).h <=> w.h, w.i, -1)), i -> i >= 0))"
        ),
    )
    repeated = F.expr(
        "coalesce(aggregate(transform(__places, (p, j) -> least(5, coalesce(get(__places, j + 1), p + 5) - p)),"
        " 0L, (sum, p) -> sum + p), 0L)"
    )
    sixth = fifth.withColumn("__repeated", repeated)
    return sixth.select(*kept, "__n", "__chars", "__symbols", "__dups", "__repeated", "__grams")


def _verdict(
    described: DataFrame, columns: list[str], ratios: list[float], threshold: float, name: str
) -> DataFrame:
    weights = ",".join(f"{ratio:g}" for ratio in ratios)
    # A constant array: the optimizer folds the split and the cast.
    table = f"cast(split('{weights}', ',') as array<double>)"
    kept = [F.col(f"`{c}`") for c in columns]
    scored = described.withColumn(
        "__score",
        F.expr(
            f"if(size(__grams) = 0, 0D, aggregate(__grams, 0D, (sum, b) -> sum + get({table}, b)) / size(__grams))"
        ),
    ).withColumn("__failed", F.expr("__n < 10 or 100 * __repeated > 20 * __n"))
    verdict = F.struct(
        F.col("__n").alias("n_words"),
        F.col("__chars").alias("word_chars"),
        F.col("__symbols").alias("n_symbols"),
        F.col("__dups").alias("n_dup_lines"),
        F.col("__repeated").alias("n_repeat_words"),
        F.col("__failed").alias("base_failed"),
        F.col("__score").alias("score"),
        (~F.col("__failed") & (F.col("__score") >= threshold)).alias("kept"),
    )
    # A condition that is always true but not constant: a filter on the verdict stays above it.
    # Pushed below, it would put whole array expressions into the lambdas over them.
    settled = F.when(F.spark_partition_id() >= 0, verdict)
    return scored.select(*kept, settled.alias(name))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; documents labelled as good are the trusted ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return assess(docs, trusted_ids(labels), columns=["doc_id"]).select("doc_id", "quality.*")
