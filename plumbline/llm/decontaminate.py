"""Benchmark decontamination through a distributed positional inverted index.

The index is a written table, one row per block of about half a MB of text: the block's documents,
its sorted terms, and for each term the positions of its occurrences.  Blocks never share a
document, so postings lists of one block are intersected where they lie and nothing of the
corpus is shuffled.  A phrase starts from the term that is rarest in the whole corpus; the lists
of the next rarer terms, moved by their offsets, are intersected with it until none is left.

The searched phrases go to all tasks in batches of bounded size, each by a pass over the index.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.words import blocks, find_words
from plumbline.storage import settle

WINDOW = 10
# Phrases that every task holds at once; about 100 bytes each.
PHRASES_AT_ONCE = 200_000
# Text bytes of a block, and bytes of a row group of the index: what a task holds of them at once.
INDEX_BLOCK, INDEX_ROW_GROUP = 1 << 19, 4 << 20

_INDEX = "block long, ids array<long>, firsts array<int>, terms binary, counts binary, postings binary"
_MATCHES = "block long, place int, phrase long, start int, stop int"


@dataclass(frozen=True)
class PhraseIndex:
    """Written postings of all words of all texts."""

    table: DataFrame

    def documents(self) -> DataFrame:
        """``block``, ``place``, ``id`` and ``n_words`` of every indexed row."""
        sized = F.expr(
            "transform(ids, (id, i) -> named_struct('place', i, 'id', id,"
            " 'n_words', cast(firsts[i + 1] - firsts[i] as long)))"
        )
        return self.table.select("block", F.inline(sized))


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> PhraseIndex:
    """Indexes every row; a null text has no words and a null id stays null."""
    texts = docs.select(
        F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")
    )

    def run(batches):
        for block in blocks(batches, "text", INDEX_BLOCK):
            words = find_words(block, "alnum")
            order = np.argsort(words.hashes, kind="stable").astype(np.uint32)
            sorted_terms = words.hashes[order]
            first = np.flatnonzero(np.r_[True, sorted_terms[1:] != sorted_terms[:-1]][: len(order)])
            counts = np.diff(np.append(first, len(order))).astype(np.uint32)
            # Any number will do that no other block has: only committed rows are ever read.
            number = int.from_bytes(os.urandom(8), "little", signed=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, block.batch.num_rows], pa.int32()), block.batch.column(0)),
                    pa.array([words.offsets.astype(np.int32)], pa.list_(pa.int32())),
                    *[pa.array([x.tobytes()], pa.binary()) for x in (sorted_terms[first], counts, order)],
                ],
                ["block", "ids", "firsts", "terms", "counts", "postings"],
            )

    rows = texts.mapInArrow(run, _INDEX)
    return PhraseIndex(settle(rows, "postings", row_group=INDEX_ROW_GROUP, large_rows=True))


def phrases_of(
    items: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW
) -> DataFrame:
    """``item`` and ``terms`` of every run of ``window`` words; a shorter item, but not one without
    words, is one phrase."""
    texts = items.select(
        F.col(id_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text")
    )

    def run(batches):
        for block in blocks(batches, "text"):
            words = find_words(block, "alnum")
            items, runs = [], []
            for i, name in enumerate(block.batch.column(0).to_pylist()):
                terms = words.hashes[words.offsets[i] : words.offsets[i + 1]].view(np.int64)
                for start in range(max(len(terms) - window + 1, min(len(terms), 1))):
                    items.append(name)
                    runs.append(terms[start : start + window])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(runs, pa.list_(pa.int64()))], ["item", "terms"]
            )

    return texts.mapInArrow(run, "item string, terms array<long>")


def _frequencies(index: PhraseIndex, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each searched term in the whole index."""
    shared = index.table.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1)):
                terms = np.frombuffer(terms.as_buffer(), np.uint64)
                counts = np.frombuffer(counts.as_buffer(), np.uint32)
                there, at = _lookup(terms, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.flatnonzero(there)), pa.array(counts[at[there]].astype(np.int64))],
                    ["term", "n"],
                )

    counted = index.table.select("terms", "counts").mapInArrow(run, "term long, n long")
    rows = counted.groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(len(vocabulary), np.int64)
    found[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return found


def _lookup(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the sorted ``terms``, and where."""
    if not len(terms):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return terms[at] == wanted, at


def _phrase(lists: list[np.ndarray], by_rarity: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of exact matches."""
    rarest = by_rarity[0]
    starts = lists[rarest].astype(np.int64) - rarest
    for offset in by_rarity[1:]:
        if not len(starts):
            break
        there, _ = _lookup(lists[offset].astype(np.int64), starts + offset)
        starts = starts[there]
    return starts, starts + len(lists) - 1


def _near(lists: list[np.ndarray], by_rarity: list[int], slop: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of matches in order with up to ``slop`` words between: from each
    occurrence of the rarest term the nearest of each neighbour is the tightest match."""
    anchor = by_rarity[0]
    low = high = lists[anchor].astype(np.int64)
    for offset in range(anchor - 1, -1, -1):
        at = np.searchsorted(lists[offset], low) - 1
        low, high = low[at >= 0], high[at >= 0]
        low = lists[offset][at[at >= 0]].astype(np.int64)
    for offset in range(anchor + 1, len(lists)):
        at = np.searchsorted(lists[offset], high, "right")
        inside = at < len(lists[offset])
        low = low[inside]
        high = lists[offset][at[inside]].astype(np.int64)
    tight = high - low + 1 <= len(lists) + slop
    return low[tight], high[tight]


def _search_batch(index: PhraseIndex, phrases: list[tuple[int, list[int]]], slop: int) -> DataFrame:
    lengths = np.array([len(terms) for _, terms in phrases])
    flat = np.array([t for _, terms in phrases for t in terms], np.int64).view(np.uint64)
    vocabulary, coded = np.unique(flat, return_inverse=True)
    rarity = _frequencies(index, vocabulary)
    owners = np.repeat(np.arange(len(phrases)), lengths)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    numbers = np.array([number for number, _ in phrases], np.int64)
    # Offsets of each phrase's terms, rarest first; phrases with a term that occurs nowhere go.
    ranked = np.lexsort((np.arange(len(flat)), rarity[coded], owners)) - offsets[owners]
    shared = index.table.sparkSession.sparkContext.broadcast(
        (vocabulary, coded, ranked, offsets, numbers, owners)
    )

    def run(batches):
        vocabulary, coded, ranked, offsets, numbers, owners = shared.value
        for batch in batches:
            for number, firsts, terms, counts, postings in zip(*batch.columns):
                firsts = firsts.values.to_numpy()
                terms = np.frombuffer(terms.as_buffer(), np.uint64)
                counts = np.frombuffer(counts.as_buffer(), np.uint32)
                postings = np.frombuffer(postings.as_buffer(), np.uint32)
                begins = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                there, at = _lookup(terms, vocabulary)
                lacking = np.bincount(owners[~there[coded]], minlength=len(numbers))
                columns: list[list] = [[], [], [], []]
                for phrase in np.flatnonzero(lacking == 0):
                    bounds = slice(offsets[phrase], offsets[phrase + 1])
                    lists = [postings[begins[i] : begins[i + 1]] for i in at[coded[bounds]]]
                    by_rarity = ranked[bounds].tolist()
                    if slop:
                        low, high = _near(lists, by_rarity, slop)
                    else:
                        low, high = _phrase(lists, by_rarity)
                    if not len(low):
                        continue
                    place = np.searchsorted(firsts, low, "right") - 1
                    inside = (low >= 0) & (high < firsts[np.minimum(place + 1, len(firsts) - 1)])
                    low, high, place = low[inside], high[inside], place[inside]
                    columns[0].append(place)
                    columns[1].append(np.full(len(low), numbers[phrase]))
                    columns[2].append(low - firsts[place])
                    columns[3].append(high + 1 - firsts[place])
                place, phrase, low, high = [np.concatenate([np.empty(0, np.int64), *c]) for c in columns]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(place), number.as_py(), np.int64)),
                        pa.array(place.astype(np.int32)),
                        pa.array(phrase),
                        pa.array(low.astype(np.int32)),
                        pa.array(high.astype(np.int32)),
                    ],
                    ["block", "place", "phrase", "start", "stop"],
                )

    searched = index.table.select("block", "firsts", "terms", "counts", "postings")
    return searched.mapInArrow(run, _MATCHES)


def search(index: PhraseIndex, phrases: DataFrame, slop: int = 0) -> DataFrame:
    """``block``, ``place`` (which row of the index), ``item``, ``start``, ``stop`` (words, end
    exclusive) of every match of every phrase.

    With ``slop`` a match has the phrase's words in order with at most so many others between
    them (proximity); without, it is the exact phrase.  Equal phrases are searched once."""
    spark = index.table.sparkSession
    owned = settle(phrases.withColumn("phrase", F.xxhash64("terms")), "phrases")
    distinct = owned.groupBy("phrase").agg(F.first("terms").alias("terms"))
    batches = -(-owned.select("phrase").distinct().count() // PHRASES_AT_ONCE)
    parts = []
    for batch in range(batches):
        held = distinct.where(F.pmod("phrase", F.lit(batches)) == batch).orderBy("phrase")
        part = [(row["phrase"], row["terms"]) for row in held.toLocalIterator()]
        if part:
            parts.append(settle(_search_batch(index, part, slop), "matches"))
    if not parts:
        return spark.createDataFrame([], "block long, place int, item string, start int, stop int")
    matches = parts[0]
    for part in parts[1:]:
        matches = matches.unionAll(part)
    owners = owned.select("phrase", "item").distinct()
    return matches.join(owners, "phrase").select("block", "place", "item", "start", "stop")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit`` (words inside matches),
    ``items`` (sorted ids of the benchmark items with matches).

    Null texts have no words and no matches; items without words match nothing; an item with a
    null id marks words but is not listed.  Repeated rows are reported each."""
    index = build_index(docs)
    row = ["block", "place"]
    matches = search(index, phrases_of(items, window=window))
    before = Window.partitionBy(*row).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        matches.select(*row, "start", "stop")
        .distinct()
        .withColumn("reached", F.coalesce(F.max("stop").over(before), F.lit(0)))
        .groupBy(*row)
        .agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reached"))).alias("n_hit"))
    )
    listed = matches.groupBy(*row).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = covered.join(listed, row)
    return index.documents().join(found, row, "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = contamination(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/benchmark.parquet"),
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH runs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
asked AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM asked WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM phrases),
met AS (
  SELECT p.item_id, d.doc_id, d.i, p.size
  FROM (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase
        FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM runs, sizes WHERE len(w) >= size)) d
  JOIN phrases p USING (phrase, size)),
hits AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM met) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY doc_id)
SELECT r.doc_id, CAST(len(coalesce(r.w, [])) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
  coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM runs r LEFT JOIN hits h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""
