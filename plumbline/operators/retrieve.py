"""Finding the reports or vectors closest to questions by cosine (RET1 to RET5, JOIN2).

Every visible document is scored against every question, as an exact search must.  A task
holds one bounded batch of questions, streams its part of the index past it in Arrow batches
and passes on its k best documents per question.  Spark has no aggregate that keeps the k
best rows: with built-in operators every pair would become a row to sort, and grouping the
words of a document would shuffle the whole text.  More questions than a batch holds make
more batches, each a pass over the index.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.limits import DEFAULT_LIMITS, Limits

# Fixed value: the text without a match.
NO_MATCH = "No matching reports were found."
RESULTS = 5
_WORD = r"[\p{L}\p{N}]+"
SCORE_DIGITS = 6
# Scores held at once by a task.
_SCORES_HELD = 2_000_000
_INVISIBLE = -np.inf

Scorer = Callable[[pa.RecordBatch], np.ndarray]

# ── the k best of each task, then of all ─────────────────────────────────────────────────


def keep(
    best: pd.DataFrame | None, asked: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int
) -> pd.DataFrame:
    """The k best so far, joined by those among ``scores`` (questions x documents)."""
    if len(ids) > k:
        # At least the k best of these documents, and all that tie with the last of them.
        least = np.partition(scores, -k, axis=1)[:, -k]
        question, row = np.nonzero((scores >= least[:, None]) & (scores > _INVISIBLE))
    else:
        question, row = np.nonzero(scores > _INVISIBLE)
    found = pd.DataFrame(
        {"question_id": asked[question], "doc_id": ids[row], "score": scores[question, row]}
    )
    if best is not None:
        found = pd.concat([best, found])
    found = found.sort_values(["question_id", "score", "doc_id"], ascending=[True, False, True])
    return found.groupby("question_id", sort=False).head(k)


def _task_topk(asked: np.ndarray, scorer: Scorer, k: int):
    step = max(1, _SCORES_HELD // len(asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                scores = np.round(scorer(part), SCORE_DIGITS) + 0.0
                ids = part.column("doc_id").to_pandas().to_numpy()
                best = keep(best, asked, ids, scores, k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return run


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """Top k per question.  The rank filter is applied in every task before the shuffle, so
    a question's group holds k rows per task however large the index is."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("question_id", "rank", "doc_id", "score")


def _result_type(index: DataFrame, questions: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("question_id", questions.schema["question_id"].dataType),
            T.StructField("doc_id", index.schema["doc_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def batches(questions: DataFrame, size: int, limit: int) -> Iterator[DataFrame]:
    """The questions in parts of about ``limit`` of their ``size``, small enough for a task."""
    number = max(1, math.ceil(size / limit))
    slot = F.pmod(F.xxhash64("question_id"), F.lit(number))
    for batch in range(number):
        yield questions.where(slot == batch)


def _union(parts: list[DataFrame], schema: T.StructType, index: DataFrame) -> DataFrame:
    if not parts:
        return index.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, parts)


# ── vectors ──────────────────────────────────────────────────────────────────────────────


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero vector stays and is similar to nothing, and so is one
    with a component that is not finite."""
    vectors = np.where(np.isfinite(vectors).all(axis=1, keepdims=True), vectors, 0.0)
    # By the largest component first, or squares of large numbers would overflow.
    peaks = np.abs(vectors).max(axis=1, initial=0.0, keepdims=True)
    vectors = np.divide(vectors, peaks, out=np.zeros_like(vectors), where=peaks > 0)
    sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, sizes, out=np.zeros_like(vectors), where=sizes > 0)


def _cosines(asked: np.ndarray) -> Scorer:
    units = unit_rows(asked)

    def score(part: pa.RecordBatch) -> np.ndarray:
        column = part.column("vector")
        fits = pc.equal(pc.list_value_length(column), asked.shape[1])
        flat = column.filter(fits).flatten().to_numpy(zero_copy_only=False)
        vectors = np.zeros((part.num_rows, asked.shape[1]))
        vectors[fits.to_numpy(zero_copy_only=False)] = flat.astype("float64").reshape(-1, asked.shape[1])
        return units @ unit_rows(vectors).T

    return score


def vector_topk(
    index: DataFrame, questions: DataFrame, k: int = RESULTS, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """RET2 on ready vectors: index (doc_id, vector), questions (question_id, vector).

    A document whose vector has another length than the question's or a component that is not
    finite scores 0, as a zero vector does.  Null vectors are no documents and no questions.
    Questions must all have one length."""
    questions = questions.where(F.col("vector").isNotNull())
    lengths = [row[0] for row in questions.select(F.size("vector")).distinct().take(2)]
    if len(lengths) > 1:
        raise ValueError(f"question vectors of different lengths: {sorted(lengths)}")
    size = questions.agg(F.sum(F.size("vector"))).first()[0] or 0
    documents = index.select("doc_id", "vector").where(F.col("vector").isNotNull())
    schema = _result_type(index, questions)
    parts = []
    for batch in batches(questions, size, limits.question_values):
        asked = batch.select("question_id", "vector").toPandas()
        if not asked.empty:
            scorer = _cosines(np.stack(asked["vector"]).astype("float64"))
            task = _task_topk(asked["question_id"].to_numpy(), scorer, k)
            parts.append(documents.mapInArrow(task, schema))
    return _ranked(_union(parts, schema, index), k)


def group_centroids(vectors: DataFrame, group: str) -> DataFrame:
    """Mean vector per group as questions; sums are combined per task and place."""
    places = vectors.select(group, F.posexplode("vector").alias("place", "value"))
    means = places.groupBy(group, "place").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    gathered = means.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct("place", "mean"))).alias("means")
    )
    return gathered.select(
        F.col(group).alias("question_id"),
        F.transform("means", lambda entry: entry["mean"]).alias("vector"),
    )


# ── text ─────────────────────────────────────────────────────────────────────────────────


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def question_terms(questions: DataFrame, index: DataFrame, documents: int) -> DataFrame:
    """RET1 for questions: (question_id, term, weight), log term frequency times smoothed
    inverse document frequency, scaled to unit length.

    Documents are only counted for words of the questions, each once per document, so one
    row per word and task is shuffled."""
    asked = (
        questions.select("question_id", F.explode(words(F.col("text"))).alias("term"))
        .groupBy("question_id", "term")
        .agg(F.count("*").alias("tf"))
    )
    vocabulary = asked.select("term").distinct()
    spread = (
        index.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
        .join(F.broadcast(vocabulary), "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )
    return term_weights(asked, spread, documents)


def term_weights(asked: DataFrame, spread: DataFrame, documents: int) -> DataFrame:
    """(question_id, term, weight) of terms with their ``tf`` in the question, and their ``df``."""
    rarity = F.log(
        F.lit(float(documents + 1)) / (F.coalesce(F.col("df"), F.lit(0)).cast("double") + 1.0)
    )
    weighted = asked.join(F.broadcast(spread), "term", "left").select(
        "question_id", "term", ((1.0 + F.log(F.col("tf").cast("double"))) * rarity).alias("raw")
    )
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("question_id")))
    share = F.coalesce(F.try_divide(F.col("raw"), length), F.lit(0.0))
    return weighted.select("question_id", "term", share.alias("weight"))


@dataclass(frozen=True)
class _Postings:
    """Weights of a batch of questions by word: ``questions[starts[w]:starts[w + 1]]`` use
    the w-th word."""

    vocabulary: pa.Array
    starts: np.ndarray
    questions: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(terms: pd.DataFrame, asked: np.ndarray) -> _Postings:
        place = pd.Series(np.arange(len(asked)), index=asked)
        codes, vocabulary = pd.factorize(terms["term"])
        order = np.argsort(codes, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(vocabulary)))])
        return _Postings(
            pa.array(vocabulary, pa.string()),
            starts.astype("int64"),
            place[terms["question_id"]].to_numpy()[order],
            terms["weight"].to_numpy(dtype="float64")[order],
        )


def _text_scores(part: pa.RecordBatch, postings: _Postings, asked: int) -> np.ndarray:
    """RET1, RET2: documents as log term frequencies scaled to unit length, times the
    questions' weights."""
    lists = part.column("words")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    encoded = lists.flatten().dictionary_encode()
    # One number per (document, word) pair; counting equal ones gives term frequencies.
    width = max(len(encoded.dictionary), 1)
    document = np.repeat(np.arange(part.num_rows, dtype="int64"), lengths)
    pairs, tf = np.unique(
        document * width + encoded.indices.to_numpy(zero_copy_only=False), return_counts=True
    )
    document, word = pairs // width, pairs % width
    weight = 1.0 + np.log(tf)
    sizes = np.sqrt(np.bincount(document, weight * weight, minlength=part.num_rows))
    weight = weight / sizes[document]
    known = pc.fill_null(pc.index_in(encoded.dictionary, postings.vocabulary), -1)
    word = known.to_numpy(zero_copy_only=False)[word] if len(word) else word
    document, weight, word = document[word >= 0], weight[word >= 0], word[word >= 0]
    # Each pair meets the questions that use its word.
    uses = postings.starts[word + 1] - postings.starts[word]
    first = np.repeat(postings.starts[word] - (np.cumsum(uses) - uses), uses)
    entry = first + np.arange(len(first))
    cell = postings.questions[entry] * part.num_rows + np.repeat(document, uses)
    product = postings.weights[entry] * np.repeat(weight, uses)
    scores = np.bincount(cell, product, minlength=asked * part.num_rows)
    return scores.reshape(asked, part.num_rows)


def _visible(part: pa.RecordBatch, scopes: pd.DataFrame) -> np.ndarray:
    """RET3: questions x documents, whether the question's scope holds the document."""
    run = part.column("run_id").to_pandas().to_numpy()
    file = part.column("filename").to_pandas().to_numpy()
    scope = scopes["scope"].to_numpy()[:, None]
    same_run = scopes["run_id"].to_numpy()[:, None] == run[None, :]
    same_file = scopes["filename"].to_numpy()[:, None] == file[None, :]
    return (scope == "all") | ((scope == "run") & same_run) | ((scope == "file") & same_file)


def question_scopes(index: DataFrame, questions: DataFrame) -> DataFrame:
    """RET3: which documents each question may see.  A run id restricts to its reports; a
    run without reports falls back to the file name, and to nothing without one."""
    asked = questions.select("question_id", "run_id", "filename")
    known = (
        index.select("run_id")
        .join(F.broadcast(asked.select("run_id").distinct()), "run_id", "left_semi")
        .distinct()
        .withColumn("known", F.lit(True))
    )
    scope = (
        F.when(F.col("run_id").isNull(), "all")
        .when(F.col("known"), "run")
        .when(F.col("filename").isNotNull() & (F.col("filename") != ""), "file")
        .otherwise("none")
    )
    return asked.join(F.broadcast(known), "run_id", "left").select(
        "question_id", scope.alias("scope"), "run_id", "filename"
    )


def in_scope(index: DataFrame, scopes: pd.DataFrame) -> DataFrame:
    """RET3: the documents that some of the restricted questions of a batch may see; others are
    neither split into words nor scored."""
    runs = [int(run) for run in scopes.loc[scopes["scope"] == "run", "run_id"].unique()]
    files = [str(name) for name in scopes.loc[scopes["scope"] == "file", "filename"].unique()]
    return index.where(F.col("run_id").isin(runs) | F.col("filename").isin(files))


def _text_scorer(postings: _Postings, scopes: pd.DataFrame) -> Scorer:
    everywhere = bool((scopes["scope"] == "all").all())

    def score(part: pa.RecordBatch) -> np.ndarray:
        scores = _text_scores(part, postings, len(scopes))
        return scores if everywhere else np.where(_visible(part, scopes), scores, _INVISIBLE)

    return score


def text_topk(
    index: DataFrame, questions: DataFrame, k: int = RESULTS, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """RET2, RET3 on text: index (doc_id, run_id, filename, text), questions (question_id,
    question, run_id, filename).  Documents without a common word score zero."""
    asked = questions.select("question_id", F.col("question").alias("text"), "run_id", "filename")
    size = asked.agg(F.sum(F.size(words(F.col("text"))) + F.lit(1))).first()[0] or 0
    number = index.count()
    schema = _result_type(index, questions)
    parts = []
    for batch in batches(asked, size, limits.question_terms):
        scopes = question_scopes(index, batch).toPandas()
        if scopes.empty:
            continue
        weights = question_terms(batch, index, number).toPandas()
        restricted = scopes["scope"] != "all"
        for some, documents in ((~restricted, index), (restricted, in_scope(index, scopes[restricted]))):
            mine = scopes[some].reset_index(drop=True)
            if not mine.empty:
                ids = mine["question_id"].to_numpy()
                used = weights[weights["question_id"].isin(ids)]
                task = _task_topk(ids, _text_scorer(_Postings.of(used, ids), mine), k)
                read = documents.select("doc_id", "run_id", "filename", words(F.col("text")).alias("words"))
                parts.append(read.mapInArrow(task, schema))
    return _ranked(_union(parts, schema, index), k)


def assemble_context(questions: DataFrame, matches: DataFrame, index: DataFrame) -> DataFrame:
    """RET4, RET5: one row per question with its context text and list of sources.

    ``matches`` has at most k rows per question, so the lists are bounded."""
    ids = matches.select("question_id", "rank", "doc_id")
    documents = index.select("doc_id", "run_id", "filename", "report_path", "text")
    texts = documents.join(ids, "doc_id")
    gathered = texts.groupBy("question_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "text", "run_id", "filename", "report_path"))
        ).alias("hits")
    )
    context = F.array_join(F.transform("hits", lambda hit: hit["text"]), "\n\n")
    sources = F.transform(
        "hits",
        lambda hit: F.struct(
            hit["run_id"].alias("run_id"),
            hit["filename"].alias("filename"),
            hit["report_path"].alias("report_path"),
        ),
    )
    empty = F.array().cast("array<struct<run_id: int, filename: string, report_path: string>>")
    return (
        questions.select("question_id", "question")
        .join(gathered, "question_id", "left")
        .select(
            "question_id",
            "question",
            F.coalesce(context, F.lit(NO_MATCH)).alias("context"),
            F.coalesce(sources, empty).alias("sources"),
        )
    )


def answer_context(
    questions: DataFrame, index: DataFrame, k: int = RESULTS, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """RET3 to RET5 for a table of questions: what a reader needs to answer each of them."""
    return assemble_context(questions, text_topk(index, questions, k, limits), index)
