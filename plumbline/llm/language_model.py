"""Language-model scoring by a weighted backoff automaton.

The model is a bigram model over words, interpolated with the smoothed unigrams.  As an
automaton: every context word is a state, every bigram seen in training an arc with its log
probability, and every state has a failure arc, weighted with the mass kept for unseen words, to
the root, whose arcs are the unigrams.  A text is read once from left to right; the state is
carried and the weights are added.

Counts cover the whole training part of the corpus and never meet in one place.  The corpus is
cut into blocks of about a million tokens.  A block asks for the counts of its distinct
n-grams; parts of the key space add up what all blocks have counted and answer each block with
totals; so each block gets the states and arcs that its texts can reach, and no others.  What is
moved is one number per distinct n-gram and block, however frequent the n-gram is.

The kept mass depends on how often the context was seen, in powers of two, and is the one of a
grid under which the training text is likeliest when each token is left out of the counts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.words import blocks, find_words, mix
from plumbline.storage import new_path

BLOCK_TOKENS = 1_000_000
# Shares of the probability that a context may keep for words not seen after it.
KEPT_MASS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0)
_BANDS = 64
# Probabilities multiplied before a logarithm is taken.
_FACTORS = 8
_ADDED = 0.1
_U = np.uint64
_END, _START = _U(0xA5A5A5A500000001), _U(0xA5A5A5A500000002)

_PAYLOAD = "block long, ids array<long>, held array<boolean>, lengths binary, words binary, homes binary, tokens binary"
_ASKED = "block long, part int, words binary, seen binary, pairs binary, met binary"
_COUNTED = "ids array<long>, held array<boolean>, lengths binary, tokens binary, seen binary, met binary, types long"
_ANSWERED = "block long, part int, words binary, pairs binary, types long"
_SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
)


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([values.tobytes()], pa.binary())


def _unpacked(value: pa.Scalar, kind) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _tight(values: np.ndarray) -> pa.Array:
    """Small numbers in wide fields, and numbers of words, pack to a fraction: all lowest bytes
    first, then all second ones, and so on."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return pa.array([zstandard.ZstdCompressor(level=1).compress(planes.tobytes())], pa.binary())


def _loose(value: pa.Scalar, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(value.as_buffer()), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _write(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cut(parts: int):
    """Blocks of whole texts: ids, held-out flags, token counts, distinct words and the parts of
    the key space they belong to, word numbers."""

    def made(texts):
        ids, held, lengths, hashes = zip(*texts)
        words, tokens, counts = np.unique(
            np.concatenate(hashes), return_inverse=True, return_counts=True
        )
        # Frequent words get small numbers, which pack best.
        order = np.argsort(-counts, kind="stable")
        numbers = np.empty(len(order), np.uint32)
        numbers[order] = np.arange(len(order), dtype=np.uint32)
        words, tokens = words[order], numbers[tokens]
        ids, held = pa.chunked_array(ids).combine_chunks(), pa.chunked_array(held).combine_chunks()
        bounds = pa.array([0, len(ids)], pa.int32())
        # Any number will do that no other block has: only committed rows are ever read.
        number = int.from_bytes(os.urandom(8), "little", signed=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]),
                pa.ListArray.from_arrays(bounds, ids),
                pa.ListArray.from_arrays(bounds, held),
                _packed(np.concatenate(lengths).astype(np.int32)),
                _packed(words),
                _tight((mix(words, 5) % _U(parts)).astype(np.uint32)),
                _tight(tokens),
            ],
            ["block", "ids", "held", "lengths", "words", "homes", "tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, size = [], 0
        for block in blocks(batches, "text"):
            found = find_words(block)
            # Every text ends with the end token.
            lengths = np.diff(found.offsets) + 1
            hashes = np.insert(found.hashes, found.offsets[1:], _END)
            texts.append((block.batch.column(0), block.batch.column(1), lengths, hashes))
            size += len(hashes)
            if size >= BLOCK_TOKENS:
                yield made(texts)
                texts, size = [], 0
        if texts:
            yield made(texts)

    return run


@dataclass(frozen=True)
class _Tokens:
    """A block's tokens; the start of a text counts as the word after the last one."""

    held: np.ndarray
    lengths: np.ndarray
    words: int
    tokens: np.ndarray
    previous: np.ndarray

    @property
    def pair_keys(self) -> np.ndarray:
        return self.previous * (self.words + 1) + self.tokens


def _read(held, lengths, words: int, tokens) -> _Tokens:
    lengths = _unpacked(lengths, np.int32).astype(np.int64)
    tokens = _loose(tokens, np.uint32).astype(np.int64)
    previous = np.empty_like(tokens)
    previous[1:] = tokens[:-1]
    previous[np.cumsum(lengths) - lengths] = words
    return _Tokens(held.values.to_numpy(zero_copy_only=False), lengths, words, tokens, previous)


def _parted(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order by part of the key space, and where each part begins."""
    # Numbers of two bytes are sorted by counting.
    order = np.argsort(part.astype(np.min_scalar_type(parts)), kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])


def _pair_homes(homes: np.ndarray, keys: np.ndarray, parts: int) -> np.ndarray:
    """The part a pair belongs to follows from those of its words; a frequent word's pairs are
    spread by the other word."""
    known = np.append(homes, parts).astype(np.uint64)
    width = len(known)
    return (mix(known[keys // width] * _U(parts + 1) + known[keys % width], 8) % _U(parts)).astype(np.int64)


def _pair_hashes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """48 bits of a hash per pair of words."""
    known = np.append(words, _START)
    previous, word = keys // (len(words) + 1), keys % (len(words) + 1)
    return mix(mix(known[previous], 6) + known[word], 7) >> _U(16)


def _six_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six_bytes(value: pa.Scalar) -> np.ndarray:
    out = np.zeros((len(value.as_buffer()) // 6, 8), np.uint8)
    out[:, :6] = _unpacked(value, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(_U)


def _ask(parts: int):
    """A block's distinct words and pairs by part, with their counts in training texts."""

    def run(batches):
        for batch in batches:
            for number, held, lengths, words, homes, tokens in zip(*batch.columns):
                words = _unpacked(words, _U)
                read = _read(held, lengths, len(words), tokens)
                trained = np.repeat(~read.held, read.lengths)
                seen = np.bincount(read.tokens[trained], minlength=len(words)).astype(np.uint32)
                keys, at = np.unique(read.pair_keys, return_inverse=True)
                met = np.bincount(at[trained], minlength=len(keys)).astype(np.uint32)
                pairs = _pair_hashes(words, keys)
                homes = _loose(homes, np.uint32)
                word_order, word_starts = _parted(homes, parts)
                pair_order, pair_starts = _parted(_pair_homes(homes, keys, parts), parts)
                for part in range(parts):
                    w = word_order[word_starts[part] : word_starts[part + 1]]
                    p = pair_order[pair_starts[part] : pair_starts[part + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number.as_py()], pa.int64()),
                            pa.array([part], pa.int32()),
                            _packed(words[w]),
                            _tight(seen[w]),
                            pa.array([_six_bytes(pairs[p])], pa.binary()),
                            _tight(met[p]),
                        ],
                        ["block", "part", "words", "seen", "pairs", "met"],
                    )

    return run


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[pa.Scalar], int]:
    """Each block's keys with the counts of all blocks, and how many keys were counted at all."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    return [_tight(x)[0] for x in np.split(sums[at], ends[:-1])], int((sums > 0).sum())


def _answer(table: pa.Table) -> pa.Table:
    """Adds up one part of the key space."""
    words, types = _totals(
        [_unpacked(x, _U) for x in table["words"]], [_loose(x, np.uint32) for x in table["seen"]]
    )
    pairs, _ = _totals(
        [_from_six_bytes(x) for x in table["pairs"]], [_loose(x, np.uint32) for x in table["met"]]
    )
    return pa.table(
        {
            "block": table["block"],
            "part": table["part"],
            "words": pa.array(words, pa.binary()),
            "pairs": pa.array(pairs, pa.binary()),
            # Told once per part.
            "types": pa.array([types] + [0] * (len(words) - 1), pa.int64()),
        }
    )


def _align(parts: int):
    """Answers put back into the order of a block's words and of its distinct pairs."""

    def run(batches):
        for batch in batches:
            for ids, held, lengths, homes, tokens, answers, types in zip(*batch.columns):
                homes = _loose(homes, np.uint32)
                keys = np.unique(_read(held, lengths, len(homes), tokens).pair_keys)
                counts = []
                for name, part in (("words", homes), ("pairs", _pair_homes(homes, keys, parts))):
                    order, _ = _parted(part, parts)
                    totals = np.empty(len(part), np.int64)
                    totals[order] = np.concatenate([_loose(x, np.int64) for x in answers.values.field(name)])
                    counts.append(_tight(totals))
                bounds = pa.array([0, len(ids.values)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(bounds, ids.values),
                        pa.ListArray.from_arrays(bounds, held.values),
                        *[pa.array([x.as_py()], pa.binary()) for x in (lengths, tokens)],
                        *counts,
                        pa.array([types.as_py()], pa.int64()),
                    ],
                    ["ids", "held", "lengths", "tokens", "seen", "met", "types"],
                )

    return run


def _counted(batches: Iterator[pa.RecordBatch]):
    """Per block: ids, tokens, the counts of its words, its distinct pairs, which of them each token
    is, and their counts."""
    for batch in batches:
        for ids, held, lengths, tokens, seen, met, _ in zip(*batch.columns):
            seen = _loose(seen, np.int64)
            read = _read(held, lengths, len(seen), tokens)
            keys, at = np.unique(read.pair_keys, return_inverse=True)
            yield ids.values, read, seen, keys, at, _loose(met, np.int64)


def _band(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), _BANDS - 1)


def _log_sums(single: np.ndarray, double: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Sums of log probabilities per band and kept mass.  The logarithm is taken of products of
    eight; none is under 1e-200."""
    order = np.argsort(band.astype(np.uint8), kind="stable")
    sizes = np.bincount(band, minlength=_BANDS)
    groups = -(-sizes // _FACTORS)
    shift = (np.cumsum(groups) - groups) * _FACTORS - (np.cumsum(sizes) - sizes)
    place = np.arange(len(order)) + np.repeat(shift, sizes)
    filled = np.ones((2, int(groups.sum()) * _FACTORS))
    filled[0, place], filled[1, place] = single[order], double[order]
    single, double = (np.ascontiguousarray(row.reshape(-1, _FACTORS).T) for row in filled)
    bands = np.repeat(np.arange(_BANDS), groups)
    sums = np.zeros((_BANDS, len(KEPT_MASS)))
    for i, mass in enumerate(KEPT_MASS):
        products = np.multiply.reduce(mass * single + (1 - mass) * double, axis=0)
        sums[:, i] = np.bincount(bands, np.log(products), _BANDS)
    return sums


def _likelihoods(total: int, types: int, starts: int):
    """Sums of log probabilities per band of contexts and kept mass, each token left out."""

    def run(batches):
        sums = np.zeros((_BANDS, len(KEPT_MASS)))
        for _, read, seen, _, at, met in _counted(batches):
            trained = np.repeat(~read.held, read.lengths)
            contexts = np.append(seen, starts)[read.previous[trained]]
            single = (seen[read.tokens[trained]] - 1 + _ADDED) / (total - 1 + _ADDED * (types + 1))
            double = (met[at[trained]] - 1) / np.maximum(contexts - 1, 1)
            sums += _log_sums(single, double, _band(contexts))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(_BANDS), len(KEPT_MASS))),
                pa.array(np.tile(np.arange(len(KEPT_MASS)), _BANDS)),
                pa.array(sums.ravel()),
            ],
            ["band", "mass", "likelihood"],
        )

    return run


@dataclass(frozen=True)
class Automaton:
    """States are words, then the start, then the root.  Arcs are sorted by state and word."""

    root: int
    arcs: np.ndarray
    weights: np.ndarray
    failure: np.ndarray
    unigrams: np.ndarray

    def weigh(self, previous: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Weights of the steps that read a word after another, or after the start (``root - 1``)."""
        # A word never trained on is no context: its state is the root.
        state = np.where(self.failure[previous] > 0, self.root, previous)
        keys = state * self.root + word
        place = np.minimum(np.searchsorted(self.arcs, keys), len(self.arcs) - 1)
        return np.where(self.arcs[place] == keys, self.weights[place], self.failure[state] + self.unigrams[word])

    def read(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log10 probability of each text.  A bigram automaton's state follows from the last word, so
        all steps are weighed at once; a text's weights are added from left to right."""
        text, first = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
        word = tokens[np.repeat(starts - first, lengths) + np.arange(len(text))]
        previous = np.full_like(word, self.root - 1)
        previous[1:] = word[:-1]
        previous[first[lengths > 0]] = self.root - 1
        return np.bincount(text, self.weigh(previous, word), len(lengths))


def build_automaton(
    seen: np.ndarray, keys: np.ndarray, met: np.ndarray, kept: np.ndarray, total: int, types: int, starts: int
) -> Automaton:
    """``seen`` counts the words, ``met`` the pairs ``keys = previous * (words + 1) + word``."""
    root = len(seen) + 1
    unigrams = (seen + _ADDED) / (total + _ADDED * (types + 1))
    contexts = np.append(seen, starts)
    known = met > 0
    previous, word = keys[known] // root, keys[known] % root
    mass = kept[_band(contexts)]
    weights = mass[previous] * unigrams[word] + (1 - mass[previous]) * met[known] / contexts[previous]
    # Positive marks words that are no state; a state's failure weight is 0 at most.
    failure = np.where(contexts > 0, np.log10(mass), 1.0)
    if not contexts[-1]:
        failure[-1] = 0.0
    return Automaton(
        root,
        np.append(keys[known], np.iinfo(np.int64).max),
        np.append(np.log10(weights), 0.0),
        np.append(failure, 0.0),
        np.log10(unigrams),
    )


def _score(total: int, types: int, starts: int, kept: np.ndarray):
    def run(batches):
        for ids, read, seen, keys, at, met in _counted(batches):
            automaton = build_automaton(seen, keys, met, kept, total, types, starts)
            begins = np.cumsum(read.lengths) - read.lengths
            known = np.add.reduceat((seen[read.tokens] > 0).astype(np.int64), begins)
            base = np.add.reduceat(automaton.unigrams[read.tokens], begins)
            # Each different step is weighed once; a text's weights are added from left to right.
            weights = automaton.weigh(*np.divmod(keys, automaton.root))[at]
            score = np.bincount(np.repeat(np.arange(len(begins)), read.lengths), weights, len(begins))
            columns = [ids, read.held, read.lengths, known, base, score]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
            )

    return run


def score_documents(
    docs: DataFrame, held_out, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (smoothed unigrams) and ``score`` (the automaton), log10.

    ``held_out`` is a boolean column; the model learns from the rows where it is false, and rows
    where it is null count as held out.  A null text is empty: one end token.  Rows are scored
    each, null ids stay null.  Without training rows every word is unknown."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.coalesce(held_out, F.lit(True)).alias("held"),
        F.col(text_column).cast("string").alias("text"),
    )
    payload = _write(texts.mapInArrow(_cut(parts), _PAYLOAD), "tokens")
    total, starts = payload.select("held", "lengths").mapInArrow(_sizes, "n long, texts long").agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))
    ).first()
    asked = payload.select("block", "held", "lengths", "words", "homes", "tokens")
    answers = asked.mapInArrow(_ask(parts), _ASKED).groupBy("part").applyInArrow(_answer, _ANSWERED)
    gathered = answers.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("part", "words", "pairs"))).alias("answers"),
        F.sum("types").alias("types"),
    )
    joined = payload.join(gathered, "block").select("ids", "held", "lengths", "homes", "tokens", "answers", "types")
    counted = _write(joined.mapInArrow(_align(parts), _COUNTED), "counted")
    types = counted.agg(F.coalesce(F.sum("types"), F.lit(0))).first()[0]
    rows = (
        counted.mapInArrow(_likelihoods(total, types, starts), "band long, mass long, likelihood double")
        .groupBy("band", "mass")
        .agg(F.sum("likelihood").alias("likelihood"))
        .collect()
    )
    best: dict[int, tuple[float, int]] = {}
    for row in rows:
        best[row["band"]] = max(best.get(row["band"], (-np.inf, 0)), (row["likelihood"], row["mass"]))
    kept = np.array([KEPT_MASS[best[b][1]] if b in best else 1.0 for b in range(_BANDS)])
    scored = counted.mapInArrow(_score(total, types, starts, kept), _SCORED)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))


def _sizes(batches):
    """Tokens and texts to learn from."""
    for batch in batches:
        for held, lengths in zip(batch.column(0), batch.column(1)):
            learned = ~held.values.to_numpy(zero_copy_only=False)
            sizes = _unpacked(lengths, np.int32).astype(np.int64)[learned]
            yield pa.RecordBatch.from_arrays([pa.array([sizes.sum()]), pa.array([len(sizes)])], ["n", "texts"])


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with a tenth of them held out by a checksum of the id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return score_documents(docs, held_out)
