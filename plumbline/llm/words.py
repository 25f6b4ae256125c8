"""Words, word hashes and shingles of many texts at once, as numpy arrays inside tasks.

A block is a run of texts laid end to end as UTF-8 bytes.  Words never cross texts.  Null
texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes handled at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    found = odd
    for _ in range(6):
        found = found * (2 - odd * found) % (1 << 64)
    return found


_BASE_INVERSE = _U(_inverse(int(_BASE)))


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them; one for each seed."""
    out = values ^ _U((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % (1 << 64))
    out ^= out >> _U(30)
    out *= _U(0xBF58476D1CE4E5B9)
    out ^= out >> _U(27)
    out *= _U(0x94D049BB133111EB)
    return out ^ (out >> _U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=_U))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACED = np.ones(256, dtype=bool)
_SPACED[[9, 10, 11, 12, 13, 32]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
# Bytes that belong to words: all but white space, or digits, letters and all beyond ASCII.
ALPHABETS = {"spaced": _SPACED, "alnum": _ALNUM}


@dataclass(frozen=True)
class Block:
    """Texts end to end: text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    batch: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray


@dataclass(frozen=True)
class Words:
    """Byte bounds and hash of each word; text ``i`` has words ``offsets[i]`` to ``offsets[i+1]``."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    filled = pc.fill_null(column, "").cast(pa.large_string())
    _, places, content = filled.buffers()
    offsets = np.frombuffer(places, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.empty(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
    return data, offsets - offsets[0]


def blocks(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES
) -> Iterator[Block]:
    """Blocks of at most ``limit`` text bytes, or of one text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            part = offsets[first : last + 1]
            yield Block(
                batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
            )
            first = last


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running hash of the bytes, and the factors that take a run's place out of it: the hash
    of ``data[a:b]`` is ``(running[b] - running[a]) * factors[a]``."""
    powers = np.full(len(data), _BASE, dtype=_U)
    if len(powers):
        powers[0] = 1
    np.cumprod(powers, out=powers)
    running = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_BYTE_VALUES[data] * powers, out=running[1:])
    factors = np.full(len(data) + 1, _BASE_INVERSE, dtype=_U)
    factors[0] = 1
    np.cumprod(factors, out=factors)
    return running, factors


def find_words(block: Block, alphabet: str = "spaced", lower: bool = True) -> Words:
    data = _LOWER[block.data] if lower else block.data
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ALPHABETS[alphabet][block.data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[block.offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    running, factors = prefix_hashes(data)
    hashes = mix((running[ends] - running[starts]) * factors[starts])
    return Words(starts, ends, hashes, np.searchsorted(starts, block.offsets))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and where each text's runs start.

    A text of fewer words, but not none, has the whole of them as its one run."""
    counts = np.diff(words.offsets)
    total = int(words.offsets[-1])
    rolled = np.zeros(total, dtype=_U)
    for step in range(size):
        stop = max(total - step, 0)
        rolled[:stop] += mix(words.hashes[step:], 0) * _U(2 * step + 3) if step else words.hashes
        rolled[:stop] = mix(rolled[:stop], step + 1)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    # The runs of text i are those that start at its first made[i] words.
    places = np.arange(offsets[-1]) + np.repeat(words.offsets[:-1] - offsets[:-1], made)
    out = rolled[places]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        run = words.hashes[words.offsets[i] : words.offsets[i + 1]]
        value = np.zeros(1, dtype=_U)
        for step, word in enumerate(run):
            value = mix(value + word, 100 + step)
        out[offsets[i]] = value[0]
    return out, offsets
