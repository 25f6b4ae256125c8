"""Text retrieval over stored postings, reading only what can reach the best k (RET2 at scale).

The index is built once.  Documents of similar length are dealt to blocks of about a thousand; a
row holds one term's documents in one block with their weights, and beside them the largest of
these weights.  Rows lie in folders by the hash of the term, sorted, so a question opens the few
files of its terms.

A question first adds up the largest weights of its terms per block, which bounds every document's
score in the block.  The most promising blocks are scored, the k-th best score found there is a
threshold, and of all other blocks only those whose bound reaches it are read.  What is left out
cannot be among the best k, so the result is that of scoring everything.  Long documents weigh a
term little, so whole blocks of them fall below the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.limits import DEFAULT_LIMITS, Limits
from plumbline.operators.retrieve import RESULTS, SCORE_DIGITS, batches, keep, term_weights, words
from plumbline.storage import settle

BLOCK_DOCUMENTS, TERM_BUCKETS, FIRST_BLOCKS = 1024, 64, 4
# Bounds and scores are sums in different orders, and scores are rounded.
_SLACK = 10.0**-SCORE_DIGITS
_CLASS_STEPS = 2
# Rows of the matrices whose product scores a block.
_TERMS_AT_ONCE = 512


def _size_class(lists: Column) -> Column:
    """Documents of about the same number of words."""
    return F.floor(F.log2(F.size(lists) + F.lit(1.0)) * _CLASS_STEPS).cast("int")


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, doc_id, weight): log term frequencies scaled to unit length."""
    for batch in batches:
        lists = batch.column(2)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        encoded = lists.flatten().dictionary_encode()
        width = max(len(encoded.dictionary), 1)
        document = np.repeat(np.arange(batch.num_rows, dtype="int64"), lengths)
        pairs, tf = np.unique(
            document * width + encoded.indices.to_numpy(zero_copy_only=False), return_counts=True
        )
        document, word = pairs // width, pairs % width
        weight = 1.0 + np.log(tf)
        weight /= np.sqrt(np.bincount(document, weight * weight, minlength=batch.num_rows))[document]
        rows = pa.array(document)
        yield pa.RecordBatch.from_arrays(
            [encoded.dictionary.take(pa.array(word)), batch.column(1).take(rows), batch.column(0).take(rows), pa.array(weight)],
            ["term", "block", "doc_id", "weight"],
        )


def _bucket(term: Column | str, number: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(number)).cast("int")


def build_postings(
    index: DataFrame, path: str, block_documents: int = BLOCK_DOCUMENTS, term_buckets: int = TERM_BUCKETS
) -> None:
    """Writes postings of (doc_id, text) under ``path``: ``documents`` and ``postings``.

    Null texts have no words.  A document id stands for one document; null ids are none."""
    documents = index.where(F.col("doc_id").isNotNull()).select(
        "doc_id", words(F.coalesce("text", F.lit(""))).alias("words")
    )
    sized = documents.withColumn("class", _size_class(F.col("words")))
    # A few dozen classes.
    counts = {row[0]: row[1] for row in sized.groupBy("class").agg(F.count("*")).collect()}
    slots = F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, math.ceil(n / block_documents))])
    slot = F.pmod(F.xxhash64("doc_id"), F.element_at(slots, F.col("class"))) if counts else F.lit(0)
    blocked = sized.withColumn("block", F.col("class").cast("long") * (1 << 32) + slot)
    blocked.select("doc_id", "block").write.parquet(f"{path}/documents")
    kind = index.schema["doc_id"].dataType.simpleString()
    entries = blocked.select("doc_id", "block", "words").mapInArrow(
        _weights, f"term string, block long, doc_id {kind}, weight double"
    )
    rows = entries.groupBy("term", "block").agg(
        F.max("weight").alias("bound"),
        F.count("*").cast("int").alias("documents"),
        # No more than the documents of a block.
        F.collect_list(F.struct("doc_id", "weight")).alias("entries"),
    )
    bucketed = rows.withColumn("bucket", _bucket("term", term_buckets))
    (
        bucketed.repartition("bucket", F.pmod(F.col("block"), F.lit(4)))
        .sortWithinPartitions("bucket", "term", "block")
        .write.partitionBy("bucket")
        .parquet(f"{path}/postings")
    )
    total = blocked.sparkSession.range(1).select(
        F.lit(sum(counts.values())).alias("documents"), F.lit(term_buckets).alias("buckets")
    )
    total.coalesce(1).write.parquet(f"{path}/facts")


@dataclass(frozen=True)
class PostingsSearch:
    """``matches`` as ``text_topk`` gives them; how many blocks times questions there are, and how
    many of them were read."""

    matches: DataFrame
    all_blocks: int
    read_blocks: int


def _block_topk(terms: pd.DataFrame, k: int):
    """The k best documents of a block for each question that it was chosen for."""
    asked, numbers = np.unique(terms["question_id"].to_numpy(), return_inverse=True)
    place = pd.Series(np.arange(len(asked)), index=asked)
    codes, vocabulary = pd.factorize(terms["term"])
    shares, known = terms["share"].to_numpy("float64"), pa.array(vocabulary, pa.string())

    def run(postings: pa.Table, chosen: pa.Table) -> pa.Table:
        ids = chosen.column("question_id").to_pandas().to_numpy()
        if not len(ids) or not postings.num_rows:
            return chosen.select(["question_id"]).slice(0, 0).append_column(
                "doc_id", postings.column("doc_ids").combine_chunks().flatten().slice(0, 0)
            ).append_column("score", pa.array([], pa.float64()))
        rows = np.full(len(asked), -1)
        rows[place[ids].to_numpy()] = np.arange(len(ids))
        word = pc.index_in(postings.column("term").combine_chunks(), known).to_numpy(zero_copy_only=False)
        lists = postings.column("doc_ids").combine_chunks()
        encoded = lists.flatten().dictionary_encode()
        document, weight = encoded.indices.to_numpy(), postings.column("weights").combine_chunks().flatten().to_numpy()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        scores = np.zeros((len(ids), len(encoded.dictionary)))
        at = np.full(len(vocabulary), -1)
        for first in range(0, len(word), _TERMS_AT_ONCE):
            part = word[first : first + _TERMS_AT_ONCE]
            start, stop = ends[first - 1] if first else 0, ends[first + len(part) - 1]
            sizes = np.diff(np.concatenate([[start], ends[first : first + len(part)]]))
            width = scores.shape[1]
            cell = np.repeat(np.arange(len(part)) * width, sizes) + document[start:stop]
            # Rows of one id add up.
            held = np.bincount(cell, weight[start:stop], len(part) * width).reshape(len(part), width)
            at[:] = -1
            at[part] = np.arange(len(part))
            used = (at[codes] >= 0) & (rows[numbers] >= 0)
            use = np.zeros((len(ids), len(part)))
            use[rows[numbers[used]], at[codes[used]]] = shares[used]
            scores += use @ held
        scores = np.round(scores, SCORE_DIGITS) + 0.0
        # Documents that score nothing are filled up by their ids.
        best = keep(None, ids, encoded.dictionary.to_pandas().to_numpy(), np.where(scores > 0, scores, -np.inf), k)
        return pa.Table.from_pandas(best, preserve_index=False)

    return run


def _block_best(chosen: DataFrame, postings: DataFrame, terms: pd.DataFrame, k: int, kinds: str) -> DataFrame:
    """(question_id, doc_id, score) of the best documents in the chosen (question_id, block).

    A block's postings meet all its questions in one group, so an entry is moved once, however many
    questions use its term, and k rows per question and block come out."""
    needed = F.broadcast(chosen.select("block").distinct())
    entries = postings.join(needed, "block", "left_semi").select(
        "block", "term", F.col("entries.doc_id").alias("doc_ids"), F.col("entries.weight").alias("weights")
    )
    grouped = entries.groupBy("block").cogroup(chosen.where("question_id IS NOT NULL").groupBy("block"))
    found = grouped.applyInArrow(_block_topk(terms, k), kinds)
    return _best(found.groupBy("question_id", "doc_id").agg(F.sum("score").alias("score")), k)


def _search(
    spark: SparkSession, path: str, questions: DataFrame, k: int, total: int, buckets: int, first_blocks: int
) -> tuple[DataFrame, int]:
    asked = (
        questions.select("question_id", F.explode(words(F.col("text"))).alias("term"))
        .groupBy("question_id", "term")
        .agg(F.count("*").alias("tf"))
    )
    asked = settle(asked, "asked")
    terms = asked.select("term").distinct()
    # Folders of other terms are not opened.
    numbers = sorted(row[0] for row in terms.select(_bucket("term", buckets)).distinct().collect())
    postings = (
        spark.read.parquet(f"{path}/postings")
        .where(F.col("bucket").isin(numbers))
        .join(F.broadcast(terms), "term", "left_semi")
    )
    frequency = postings.groupBy("term").agg(F.sum("documents").alias("df"))
    weights = settle(term_weights(asked, frequency, total).withColumnRenamed("weight", "share"), "weights")
    bounds = settle(
        postings.select("term", "block", "bound")
        .join(F.broadcast(weights), "term")
        .groupBy("question_id", "block")
        .agg(F.sum(F.col("share") * F.col("bound")).alias("bound")),
        "bounds",
    )
    promising = Window.partitionBy("question_id").orderBy(F.desc("bound"), "block")
    ranked = bounds.withColumn("place", F.row_number().over(promising))
    first = settle(ranked.where(F.col("place") <= first_blocks), "first-blocks")
    # Bounded by the words of a batch.
    held = weights.where("question_id IS NOT NULL").select("question_id", "term", "share").toPandas()
    kinds = ", ".join(
        f"{name} {kind.simpleString()}"
        for name, kind in (
            ("question_id", questions.schema["question_id"].dataType),
            ("doc_id", postings.schema["entries"].dataType.elementType["doc_id"].dataType),
            ("score", T.DoubleType()),
        )
    )
    best = settle(_block_best(first.select("question_id", "block"), postings, held, k, kinds), "first-scores")
    threshold = best.groupBy("question_id").agg(
        F.min(F.when(F.col("rank") == k, F.col("score"))).alias("threshold")
    )
    rest = (
        bounds.join(first.select("question_id", "block"), ["question_id", "block"], "left_anti")
        .join(F.broadcast(threshold), "question_id", "left")
        .where(F.col("threshold").isNull() | (F.col("bound") + _SLACK >= F.col("threshold")))
        .select("question_id", "block")
    )
    rest = settle(rest, "rest-blocks")
    others = _block_best(rest, postings, held, k, kinds)
    return best.unionByName(others).drop("rank"), first.count() + rest.count()


def _best(scored: DataFrame, k: int) -> DataFrame:
    rounded = scored.withColumn("score", F.round("score", SCORE_DIGITS))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings_topk(
    spark: SparkSession,
    path: str,
    questions: DataFrame,
    k: int = RESULTS,
    first_blocks: int = FIRST_BLOCKS,
    limits: Limits = DEFAULT_LIMITS,
) -> PostingsSearch:
    """RET2 on text: the k best of all documents for each of (question_id, question), as
    ``text_topk`` finds them by scoring all.  Documents without a common word score zero and fill
    up what is missing, by their ids."""
    facts = spark.read.parquet(f"{path}/facts").first()
    documents = spark.read.parquet(f"{path}/documents")
    asked = questions.select("question_id", F.col("question").alias("text"))
    if not facts.documents:
        kinds = {name: df.schema[name].dataType.simpleString() for name, df in (("question_id", asked), ("doc_id", documents))}
        none = f"question_id {kinds['question_id']}, rank int, doc_id {kinds['doc_id']}, score double"
        return PostingsSearch(spark.createDataFrame([], none), 0, 0)
    size = asked.agg(F.sum(F.size(words(F.col("text"))) + F.lit(1))).first()[0] or 0
    # Of these some k are no hits of a question with fewer than k of them.
    fill = [row[0] for row in documents.select("doc_id").orderBy("doc_id").limit(2 * k).collect()]
    parts, read = [], 0
    for batch in batches(asked, size, limits.question_terms):
        found, blocks = _search(spark, path, batch, k, facts.documents, facts.buckets, first_blocks)
        parts.append(found)
        read += blocks
    ids = F.array(*[F.lit(i) for i in fill]).cast(f"array<{documents.schema['doc_id'].dataType.simpleString()}>")
    filled = asked.select("question_id", F.explode(ids).alias("doc_id"), F.lit(0.0).alias("score"))
    for part in parts:
        filled = filled.unionByName(part.select("question_id", "doc_id", "score"))
    once = filled.groupBy("question_id", "doc_id").agg(F.max("score").alias("score"))
    matches = _best(once, k).select("question_id", "rank", "doc_id", "score")
    blocks = documents.select("block").distinct().count()
    return PostingsSearch(matches, blocks * questions.count(), read)
