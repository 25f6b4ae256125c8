"""Token counts by byte-pair merging over a heap and a linked list.

Only the number of tokens is asked for, so no identifier is ever looked up.  The characters of a
word are linked to their neighbours, and every adjacent pair that the model can merge waits in a
heap under its rank.  The lowest rank is popped again and again, of equal ones the leftmost; a
merge joins two links and offers the two new pairs.  The count is the number of symbols at the
start less the number of merges.  A word of n characters takes n log n steps, so a text without
any space is no special case.

No piece goes beyond a word's end, which is checked when a model is loaded, so the count of a text
is the sum over its words.  A task remembers the counts of recent words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.words import blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LIMIT = 4096
# Fixed value: the format's mark of a space.
_MARK = "▁"
# Characters of the words whose counts a task remembers, at most, and of one such word.
_REMEMBERED, _SHORT = 4_000_000, 64


@dataclass(frozen=True)
class MergeRanks:
    """What counting needs of a model.

    ``ranks`` gives each piece of several characters the rank of its merge, ``single`` holds the
    characters that are pieces.  Others are spelled in bytes, one token each."""

    ranks: dict[str, int]
    single: frozenset[str]
    leading_mark: bool


def load_ranks(path: str = MODEL) -> MergeRanks:
    """Reads a SentencePiece BPE model with byte pieces and without normalization, on the driver."""
    import sentencepiece

    from plumbline.llm.pieces import _fields

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    fields = list(_fields(model.serialized_model_proto()))
    trainer = dict(_fields(dict(fields).get(2, b"")))
    normalizer = dict(_fields(dict(fields).get(3, b"")))
    kinds = Counter(dict(_fields(value)).get(3, 1) for field, value in fields if field == 1)
    # Kinds of pieces 1 normal, 2 unknown, 3 control, 6 byte; model type 2 BPE.
    if trainer.get(3, 1) != 2 or set(kinds) - {1, 2, 3, 6} or kinds[6] != 256:
        raise ValueError("counting needs a BPE model with byte pieces and no pieces of the user's")
    if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1):
        raise ValueError("counting needs a model that keeps texts as they are and marks spaces")
    usual = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    pieces = {model.id_to_piece(i): model.get_score(i) for i in usual}
    if any(_MARK in piece.lstrip(_MARK) or "\n" in piece for piece in pieces):
        raise ValueError("a piece goes beyond a word's end")
    order = {score: rank for rank, score in enumerate(sorted(set(pieces.values()), reverse=True))}
    return MergeRanks(
        {piece: order[score] for piece, score in pieces.items() if len(piece) > 1},
        frozenset(piece for piece in pieces if len(piece) == 1),
        bool(normalizer.get(3, 1)),
    )


def merged_count(word: str, ranks: dict[str, int], single: frozenset[str]) -> int:
    """Tokens of one word."""
    size = len(word)
    symbols = size
    for character in word:
        if character not in single:
            symbols += len(character.encode("utf-8", "surrogatepass")) - 1
    # A waiting pair is rank * size + place of its left symbol, so that equal ranks go leftmost
    # first.  Symbol i is word[i:after[i]]; the one after it begins at after[i].
    waiting = []
    for place in range(size - 1):
        rank = ranks.get(word[place : place + 2])
        if rank is not None:
            waiting.append(rank * size + place)
    if not waiting:
        return symbols
    heapify(waiting)
    after = list(range(1, size + 1))
    before = list(range(-1, size - 1))
    merges = 0
    while waiting:
        rank, left = divmod(heappop(waiting), size)
        right = after[left]
        # Outdated if a symbol of the pair is gone, or has grown and makes another pair.
        if right == 0 or right >= size or ranks.get(word[left : after[right]]) != rank:
            continue
        end = after[left] = after[right]
        after[right] = 0
        merges += 1
        if end < size:
            before[end] = left
            rank = ranks.get(word[left : after[end]])
            if rank is not None:
                heappush(waiting, rank * size + left)
        left_of = before[left]
        if left_of >= 0:
            rank = ranks.get(word[left_of:end])
            if rank is not None:
                heappush(waiting, rank * size + left_of)
    return symbols - merges


class WordCounts(dict):
    """Counts of words, made when first asked for; long words are counted every time."""

    def __init__(self, model: MergeRanks):
        super().__init__()
        self.ranks, self.single = model.ranks, model.single
        self.held = 0

    def __missing__(self, word: str) -> int:
        count = merged_count(word, self.ranks, self.single)
        if len(word) <= _SHORT:
            if self.held > _REMEMBERED:
                self.clear()
                self.held = 0
            self.held += len(word) + 1
            self[word] = count
        return count


def counter(model: MergeRanks):
    """A function from a text to its number of tokens."""
    known = WordCounts(model)
    words = re.compile(f"{_MARK}*[^{_MARK}\n]+|{_MARK}+|\n").findall
    lead = _MARK if model.leading_mark else ""

    def count(text: str) -> int:
        # A mark in a text reads as a space.
        return sum(map(known.__getitem__, words(lead + text.replace(" ", _MARK)))) if text else 0

    return count


def count_tokens(
    docs: DataFrame,
    model: MergeRanks,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` per row of ``docs``.

    The count is that of the model's own encoding without added tokens; the strings of control
    pieces inside a text are text.  Null and empty texts have no bytes and no tokens.  Every row
    is counted for itself, so repeated and null ids stay; other columns are not used.  Nothing is
    shuffled, and a task holds one block of texts and a bounded table of recent words."""
    # Plain values, so that tasks need no import of the package.
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(MergeRanks(**shared.value))
        for block in blocks(batches, "text"):
            texts = pc.fill_null(block.batch.column(1), "").to_pylist()
            tokens = np.fromiter(map(count, texts), np.int64, len(texts))
            sizes = np.diff(block.offsets).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [block.batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op13_token_counts(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_ranks(model))
