"""Removing repeated byte strings by sorting suffixes, deep-shallow.

A string of ``length`` bytes that occurs twice holds the same anchors both times: the places
where the hash of a short gram is smallest within some window of the string.  So only suffixes
that start at anchors are sorted, about one in seventy.

Of these only those whose gram occurs at two anchors at least take part, with the bytes on both
sides that strings of ``length`` bytes can hold, their context.  A fixed bitmap of gram hashes says
which; it may let others through.

A gram that occurs more often than one task should hold makes no group.  The strings that hold an
anchor start at most ``length - gram`` bytes before it; those that start in some range of places
before it all hold the bytes from the first to the last place common to them, a segment.  For the
contexts of frequent grams the range is cut into eight, whose segments are counted like grams, and
where these are frequent too into single places, whose segments are whole strings: a frequent one is
repeated, and needs no group.  So no group has more than a bounded share of all anchors.

Anchors with the same gram or segment meet in one group.  Their suffixes are put in order by
multikey quicksort to a shallow depth; those still equal go into a blind trie, which orders them
with one comparison each.  The common prefixes of neighbours give all groups of suffixes that agree
for some depth; inside such a group the longest common context to the left is found in the order of
the reversed contexts.  Where both together reach ``length`` bytes, the string is repeated.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.words import blocks, mix, prefix_hashes
from plumbline.storage import settle

LENGTH = 200
GRAM = 48
_SHALLOW = 64
# Bits of the map of grams or segments that occur twice: 16 MB in every task and level.
_MAP_BITS = 1 << 27
_BITMAP_BITS = 32768
# Text bytes handled at once: their hashes and windows take about a hundred times as much.
_BLOCK = 1 << 18
# Anchors that may meet in one group: this share of all anchors, which is little beside a task's
# part, but not fewer than GROUP, nor more than fit a task easily.  Segments that occur more often are
# sent out, at most _FREQUENT of them.
_SHARE = 512
GROUP = 1024
_LARGEST = 1 << 16
_FREQUENT = 1 << 21
# Pieces that each level cuts a range of places into; the last one leaves single places.
_PIECES = (8, 1 << 30)


def _sliding(values: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` over every run of ``width`` values: two scans over pieces of that width."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    neutral = np.iinfo(values.dtype).max if of is np.minimum else np.iinfo(values.dtype).min
    pieces = np.pad(values, (0, -len(values) % width), constant_values=neutral).reshape(-1, width)
    forward = of.accumulate(pieces, axis=1).ravel()
    backward = of.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(backward[:count], forward[width - 1 : width - 1 + count])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors, and the hashes of their grams.  Windows do not cross texts."""
    window = length - gram + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    running, factors = prefix_hashes(data)
    grams = len(data) - gram + 1
    hashes = mix((running[gram:] - running[:-gram]) * factors[:grams]) | np.uint64(1)
    lowest = _sliding(hashes, window, np.minimum)
    # A window counts if the whole string lies in one text.
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    lowest[text[: len(lowest)] != text[length - 1 : length - 1 + len(lowest)]] = 0
    # A gram is an anchor if it is the lowest of some window that holds it.
    padded = np.pad(lowest, (window - 1, window - 1))
    best = _sliding(padded, window, np.maximum)[:grams]
    places = np.flatnonzero(hashes == best)
    return places, hashes[places]


@dataclass(frozen=True)
class Contexts:
    """Contexts end to end: the anchors' places, and their bytes to the left and to the right."""

    raw: bytes
    places: np.ndarray
    left: np.ndarray
    right: np.ndarray
    running: np.ndarray
    factors: np.ndarray

    @classmethod
    def of(cls, before: list[bytes], after: list[bytes]) -> Contexts:
        raw = b"".join(piece for a, b in zip(before, after) for piece in (a[::-1], b))
        left, right = (np.array([len(x) for x in side], np.int64) for side in (before, after))
        ends = np.cumsum(left + right)
        return cls(raw, ends - right, left, right, *prefix_hashes(np.frombuffer(raw, np.uint8)))

    def segments(self, which: np.ndarray, first: int, last: int, length: int) -> np.ndarray:
        """Hashes of the bytes common to all strings that start ``first`` to ``last`` bytes before
        an anchor."""
        low, high = self.places[which] - first, self.places[which] + length - last
        return mix((self.running[high] - self.running[low]) * self.factors[low], 1 + first * (length + 1) + last)


def pieces(first: int, last: int, count: int) -> list[tuple[int, int]]:
    """The range cut into at most ``count`` ranges of about equal size."""
    width = -(-(last - first + 1) // count)
    return [(at, min(at + width - 1, last)) for at in range(first, last + 1, width)]


@dataclass(frozen=True)
class _Level:
    """Bits of the segments that occur twice, sorted hashes of the frequent ones (both broadcast), and
    the number from which they are frequent."""

    shared: Any
    frequent: Any
    bound: int

    def is_shared(self, hashes: np.ndarray) -> np.ndarray:
        spot = (hashes % np.uint64(_MAP_BITS)).astype(np.int64)
        return ((self.shared.value[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)

    def is_frequent(self, hashes: np.ndarray) -> np.ndarray:
        known = self.frequent.value
        if not len(known):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return known[at] == hashes


def _visit(held: Contexts, levels: list[_Level], length: int, gram: int):
    """``(level, first, last, contexts, hashes)`` of all ranges of the first level, and of the parts
    of frequent segments' ranges on the next one, down to the first level not known yet."""

    def parts(level: int, first: int, last: int, which: np.ndarray):
        for a, b in pieces(first, last, _PIECES[level]):
            fit = which[(held.left[which] >= a) & (held.right[which] >= length - b)]
            if not len(fit):
                continue
            hashes = held.segments(fit, a, b, length)
            yield level, a, b, fit, hashes
            if level < len(levels) and level + 1 < len(_PIECES):
                often = fit[levels[level].is_frequent(hashes)]
                if len(often):
                    yield from parts(level + 1, a, b, often)

    yield from parts(0, 0, length - gram, np.arange(len(held.places)))


def _common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, from ``start`` on where it is known."""
    low, high = start, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class _Node:
    __slots__ = ("children", "depth", "leaf")

    def __init__(self, depth: int, leaf: int):
        self.depth, self.leaf, self.children = depth, leaf, {}


def blind_trie_order(strings: list[bytes], items: list[int]) -> list[int]:
    """Sorts different strings by a trie that holds only branching bytes and their depths.

    A string first goes down by these bytes alone, is compared once with the leaf it reaches,
    and is put in where the two part.  Byte -1 stands for the end of a string."""
    size = 1 << 30
    root = _Node(size, items[0])
    for item in items[1:]:
        string = strings[item]
        node = root
        while node.children:
            byte = string[node.depth] if node.depth < len(string) else -1
            node = node.children.get(byte) or next(iter(node.children.values()))
        other = strings[node.leaf]
        depth = _common(string, other)
        byte = string[depth] if depth < len(string) else -1
        other_byte = other[depth] if depth < len(other) else -1
        parent, node, taken = None, root, None
        while node.depth < depth:
            parent, taken = node, string[node.depth] if node.depth < len(string) else -1
            node = node.children[taken]
        if node.depth == depth and node.children:
            node.children[byte] = _Node(size, item)
            continue
        branch = _Node(depth, item)
        branch.children = {byte: _Node(size, item), other_byte: node}
        if parent is None:
            root = branch
        else:
            parent.children[taken] = branch
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.children:
            stack.extend(node.children[byte] for byte in sorted(node.children, reverse=True))
        else:
            order.append(node.leaf)
    return order


def deep_shallow_order(strings: list[bytes], shallow: int = _SHALLOW) -> list[int]:
    """Order of different strings: multikey quicksort on eight bytes a step to depth ``shallow``,
    blind tries below."""
    order: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) <= 1:
            order.extend(items)
        elif depth >= shallow:
            order.extend(blind_trie_order(strings, items))
        else:
            keys = [strings[i][depth : depth + 8] for i in items]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, key in zip(items, keys) if key < pivot]
            same = [i for i, key in zip(items, keys) if key == pivot]
            more = [i for i, key in zip(items, keys) if key > pivot]
            stack.append((more, depth))
            # Strings that end inside the step are equal to each other as a whole.
            stack.append((same, depth + 8 if len(pivot) == 8 else shallow))
            stack.append((less, depth))
    return order


def repeats(members: list[tuple[bytes, bytes]], counts: list[int], length: int) -> list[tuple[int, int]]:
    """For each different ``(reversed left, right)`` context of a segment: how far to the left and to
    the right of the anchor bytes recur at another anchor.  All repeated strings found there
    hold the anchor, so what they cover is one run."""
    found = [(0, 0)] * len(members)
    for i, (left, right) in enumerate(members):
        if counts[i] > 1 and len(left) + len(right) >= length:
            found[i] = len(left), len(right)
    if len(members) == 1:
        return found
    rights = sorted({right for _, right in members})
    at = {right: i for i, right in enumerate(rights)}
    by_right: list[list[int]] = [[] for _ in rights]
    for i, (_, right) in enumerate(members):
        by_right[at[right]].append(i)
    suffixes = deep_shallow_order(rights) if len(rights) > 1 else [0]
    lefts = list({left: None for left, _ in members})
    ranks = {lefts[i]: rank for rank, i in enumerate(deep_shallow_order(lefts) if len(lefts) > 1 else [0])}
    # Members in the order of their left contexts, as one number each.
    size = len(members)
    keys = [ranks[left] * size + i for i, (left, _) in enumerate(members)]

    def meet(one: int, other: int, depth: int) -> None:
        """Two members whose suffixes agree for ``depth`` bytes."""
        one, other = one % size, other % size
        left = _common(members[one][0], members[other][0])
        if left + depth >= length:
            for i in (one, other):
                found[i] = max(found[i][0], left), max(found[i][1], depth)

    def merge(one: list[int], other: list[int], depth: int) -> list[int]:
        """Both groups' suffixes agree for ``depth`` bytes.  Only members that get a new neighbour
        can have a longer context in common with one than before."""
        large, small = (one, other) if len(one) >= len(other) else (other, one)
        if len(small) * 16 < len(large):
            for key in small:
                insort(large, key)
        else:
            large = sorted(large + small)
        for key in small:
            at = bisect_left(large, key)
            if at:
                meet(large[at - 1], key, depth)
            if at + 1 < len(large):
                meet(key, large[at + 1], depth)
        return large

    # Groups of suffixes by depth of agreement, from the common prefixes of neighbours.
    open_groups: list[tuple[int, list[int]]] = []
    for place, number in enumerate(suffixes):
        group = sorted(keys[i] for i in by_right[number])
        for one, other in zip(group, group[1:]):
            meet(one, other, len(rights[number]))
        shared = _common(rights[number], rights[suffixes[place + 1]]) if place + 1 < len(suffixes) else -1
        while open_groups and open_groups[-1][0] >= max(shared, 0):
            depth, held = open_groups.pop()
            group = merge(held, group, depth)
        if shared >= 0:
            open_groups.append((shared, group))
    return found


def _gram_counts(length: int, gram: int):
    """Grams of anchors, counted per block."""

    def run(batches):
        for block in blocks(batches, "text", _BLOCK):
            _, hashes = anchors(block.data, block.offsets, length, gram)
            grams, counts = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts, pa.int64())], ["segment", "n"])

    return run


def _contexts(length: int, gram: int, known: _Level):
    """Per block and different context of a shared gram: the anchors that have it.  Contexts of
    frequent grams are marked, and dealt out evenly."""

    def run(batches):
        for block in blocks(batches, "text", _BLOCK):
            offsets = block.offsets
            places, hashes = anchors(block.data, offsets, length, gram)
            kept = known.is_shared(hashes)
            places, hashes = places[kept], hashes[kept]
            if not len(places):
                continue
            text = np.searchsorted(offsets, places, "right") - 1
            starts = offsets[text]
            low = np.maximum(places - (length - gram), starts)
            high = np.minimum(places + length, offsets[text + 1])
            often = known.is_frequent(hashes)
            running, factors = prefix_hashes(block.data)
            own = mix((running[high] - running[low]) * factors[low])
            keys = np.where(often, own, hashes).view(np.int64)
            raw = block.data.tobytes()
            ids, digests = block.batch.column(0).to_pylist(), block.batch.column(1).to_pylist()
            held: dict[tuple[int, bool, bytes, bytes], list[tuple[int, int, int]]] = {}
            for place, key, far, i, start, a, b in zip(*(x.tolist() for x in (places, keys, often, text, starts, low, high))):
                context = (key, far, raw[a:place][::-1], raw[place:b])
                held.setdefault(context, []).append((ids[i], digests[i], place - start))
            # Contexts of frequent grams form no groups; equal ones of different blocks go anywhere.
            dealt = {(hash((c[0], m[0])), *c[1:]) if c[1] else c: m for c, m in held.items()}
            yield _context_rows(dealt)

    return run


def _context_rows(held: dict[tuple[int, bool, bytes, bytes], list[tuple[int, int, int]]]) -> pa.RecordBatch:
    bounds = pa.array(np.concatenate([[0], np.cumsum([len(m) for m in held.values()])]).astype(np.int32))
    flat = [m for each in held.values() for m in each]
    lists = [pa.ListArray.from_arrays(bounds, pa.array([m[k] for m in flat], pa.int64())) for k in range(3)]
    kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())
    keys = [pa.array([c[k] for c in held], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([*keys, *lists], _CONTEXT_NAMES)


_CONTEXT_NAMES = ["segment", "frequent", "before", "after", "ids", "digests", "places"]
_CONTEXTS = (
    "segment long, frequent boolean, before binary, after binary, ids array<long>, digests array<long>, places array<long>"
)
_RUN_NAMES = ["id", "digest", "start", "stop"]
_RUN_COLUMNS = [pa.list_(pa.int64())] * 4
# Runs as lists, or a context of a frequent gram as it came.
_FOUND_NAMES = ["runs_of", "runs_in", "starts", "stops", *_CONTEXT_NAMES[2:]]
_RUN_LISTS = "runs_of array<long>, runs_in array<long>, starts array<long>, stops array<long>"
_FOUND = (
    f"{_RUN_LISTS}, before binary, after binary, ids array<long>, digests array<long>, places array<long>"
)


def _repeated(length: int):
    """Runs of bytes to remove, as one row per batch; contexts of frequent grams pass through.
    Rows come sorted by gram or segment; those of one are held at a time."""

    def flush(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        contexts: dict[tuple[bytes, bytes], list[tuple[int, int, int]]] = {}
        for _, before, after, ids, digests, places in rows:
            contexts.setdefault((before, after), []).extend(zip(ids, digests, places))
        if len(contexts) == 1 and len(next(iter(contexts.values()))) == 1:
            return []
        members = list(contexts)
        out = []
        for context, (left, right) in zip(members, repeats(members, [len(contexts[m]) for m in members], length)):
            if right:
                out += [(i, d, place - left, place + right) for i, d, place in contexts[context]]
        return out

    def row(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[], [], [], []]
        runs = [pa.array([column], pa.list_(pa.int64())) for column in columns]
        none = [pa.nulls(1, kind) for kind in (pa.binary(), pa.binary(), *_RUN_COLUMNS[:3])]
        return pa.RecordBatch.from_arrays([*runs, *none], _FOUND_NAMES)

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            far = batch.filter(batch.column(1))
            if far.num_rows:
                none = [pa.nulls(far.num_rows, kind) for kind in _RUN_COLUMNS]
                yield pa.RecordBatch.from_arrays([*none, *far.columns[2:]], _FOUND_NAMES)
            out = []
            near = batch.filter(pc.invert(batch.column(1)))
            for each in zip(*(near.column(k).to_pylist() for k in (0, 2, 3, 4, 5, 6))):
                if rows and rows[-1][0] != each[0]:
                    out += flush(rows)
                    rows = []
                rows.append(each)
            yield row(out)
        if rows:
            yield row(flush(rows))

    return run


def _held(batch: pa.RecordBatch) -> Contexts:
    return Contexts.of(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def _pieces_of(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def _segment_counts(length: int, gram: int, levels: list[_Level]):
    """Segments of the first level that is not known yet, counted per batch of contexts."""

    def run(batches):
        for batch in _pieces_of(batches):
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            seen = [x for x in _visit(_held(batch), levels, length, gram) if x[0] == len(levels)]
            if seen:
                hashes = np.concatenate([x[4] for x in seen])
                segments, at = np.unique(hashes, return_inverse=True)
                counts = np.bincount(at, np.concatenate([sizes[x[3]] for x in seen])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(segments.view(np.int64)), pa.array(counts)], ["segment", "n"])

    return run


def _narrow_contexts(length: int, gram: int, levels: list[_Level]):
    """Contexts of shared segments that are not frequent, as wide as strings of their ranges need."""

    def run(batches):
        for batch in _pieces_of(batches):
            held, whole = _held(batch), [column.to_pylist() for column in batch.columns[2:]]
            out: dict[tuple[int, bool, bytes, bytes], list[tuple[int, int, int]]] = {}
            for level, first, last, which, hashes in _visit(held, levels, length, gram):
                kept = levels[level].is_shared(hashes) & ~levels[level].is_frequent(hashes)
                which, keys = which[kept], hashes[kept].view(np.int64)
                places = held.places[which]
                low = places - np.minimum(held.left[which], last)
                high = places + np.minimum(held.right[which], length - first)
                for i, key, place, a, b in zip(*(x.tolist() for x in (which, keys, places, low, high))):
                    context = (key, False, held.raw[a:place][::-1], held.raw[place:b])
                    out.setdefault(context, []).extend(zip(*(lists[i] for lists in whole)))
            if out:
                yield _context_rows(out)

    return run


def _frequent_runs(length: int, gram: int, levels: list[_Level]):
    """Runs of bytes covered by frequent strings, which are the frequent segments of single places.
    All of one anchor hold it, so they are one run.  One row of lists per batch of contexts."""

    def run(batches):
        for batch in _pieces_of(batches):
            held = _held(batch)
            before = np.full(batch.num_rows, -1)
            behind = np.full(batch.num_rows, -1)
            for level, first, _, which, hashes in _visit(held, levels, length, gram):
                if level + 1 == len(_PIECES):
                    which = which[levels[level].is_frequent(hashes)]
                    before[which] = np.maximum(before[which], first)
                    behind[which] = np.maximum(behind[which], length - first)
            covered = np.flatnonzero(behind >= 0)
            if len(covered):
                ids, digests, places = (column.take(pa.array(covered)) for column in batch.columns[2:])
                sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
                at = places.flatten().to_numpy()
                starts, stops = at - np.repeat(before[covered], sizes), at + np.repeat(behind[covered], sizes)
                whole = pa.array([0, len(at)], pa.int32())
                flat = (ids.flatten(), digests.flatten(), pa.array(starts), pa.array(stops))
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(whole, values) for values in flat], _FOUND_NAMES[:4]
                )

    return run


def _level(spark: SparkSession, counted: DataFrame, bound: int = 0) -> _Level:
    """What occurs twice, and what is too frequent for one group: above ``bound`` if it is given."""
    often = settle(counted.groupBy("segment").agg(F.sum("n").alias("n")).where("n > 1"), "segments")
    total = often.agg(F.sum("n")).first()[0] or 0
    bound = max(bound or max(GROUP, min(total // _SHARE, _LARGEST)), total // _FREQUENT)
    spot = f"shiftrightunsigned(shiftleft(segment, {64 - 27}), {64 - 27})"
    rows = (
        often.select(F.expr(spot).alias("spot"))
        .groupBy(F.floor(F.col("spot") / _BITMAP_BITS).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("spot") % _BITMAP_BITS).alias("bits"))
    )
    bits = np.zeros(_MAP_BITS // 8, np.uint8)
    for row in rows.toLocalIterator():
        start = int(row["part"]) * _BITMAP_BITS // 8
        bits[start : start + _BITMAP_BITS // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    # At most _FREQUENT of them reach the bound, as their numbers add up to at most the total.
    frequent = often.where(F.col("n") > bound).select("segment").toArrow()["segment"].to_numpy()
    known = np.sort(frequent.astype(np.int64).view(np.uint64))
    return _Level(spark.sparkContext.broadcast(bits), spark.sparkContext.broadcast(known), bound)


def _grouped(spark: SparkSession, contexts: DataFrame, length: int) -> DataFrame:
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(_repeated(length), _FOUND)


def _lists(found: DataFrame) -> DataFrame:
    return found.where("before IS NULL").select(*_FOUND_NAMES[:4])


def _frequent(spark: SparkSession, far: DataFrame, length: int, gram: int, bound: int) -> DataFrame:
    """Lists of runs at anchors of frequent grams, from their contexts."""
    levels: list[_Level] = []
    while len(levels) < len(_PIECES) and (not levels or len(levels[-1].frequent.value)):
        counted = far.mapInArrow(_segment_counts(length, gram, levels), "segment long, n long")
        levels = [*levels, _level(spark, counted, bound)]
    found = _lists(_grouped(spark, far.mapInArrow(_narrow_contexts(length, gram, levels), _CONTEXTS), length))
    return found.unionByName(far.mapInArrow(_frequent_runs(length, gram, levels), _RUN_LISTS))


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM
) -> DataFrame:
    """``id``, ``text``, ``runs`` and ``kept`` per row: the bytes covered by strings of ``length``
    bytes that also start elsewhere, as sorted maximal ``(start, stop)``, and the other bytes.

    Matches lie within texts; the same text is elsewhere too; strings may overlap and are judged
    on the texts as they are.  A null text is empty; rows are treated each, so a row that is
    there twice is repeated.  Rows with one id and equal texts get the same runs."""
    spark = docs.sparkSession
    texts = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(text_column).cast("string"), F.lit(""))).alias("digest"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    long_enough = texts.where(F.octet_length("text") >= length)
    grams = _level(spark, long_enough.mapInArrow(_gram_counts(length, gram), "segment long, n long"))
    found = _grouped(spark, long_enough.mapInArrow(_contexts(length, gram, grams), _CONTEXTS), length)
    if len(grams.frequent.value):
        found = settle(found, "found")
        far = found.where("before IS NOT NULL").select("before", "after", "ids", "digests", "places")
        found = _lists(found).unionByName(_frequent(spark, far, length, gram, grams.bound))
    found = found.select(F.expr("inline(arrays_zip(runs_of, runs_in, starts, stops))")).toDF(*_RUN_NAMES)
    runs = settle(
        found.groupBy("id", "digest").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("runs")),
        "runs",
    )
    joined = texts.alias("t").join(
        runs.alias("r"), F.expr("t.id <=> r.id and t.digest = r.digest"), "left"
    )
    return joined.select(F.col("t.id").alias("id"), "text", "runs").mapInArrow(_apply, _KEPT)


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_KEPT = "id long, text string, runs array<struct<start:bigint,stop:bigint>>, kept binary"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges runs that touch, and takes them out of the bytes."""
    for block in blocks(batches, "text", _BLOCK):
        lists, runs, kept = block.batch.column(2), [], []
        for i, (first, last) in enumerate(zip(block.offsets[:-1], block.offsets[1:])):
            raw = block.data[first:last].tobytes()
            merged: list[list[int]] = []
            for span in lists[i].as_py() or []:
                if merged and span["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], span["stop"])
                else:
                    merged.append([span["start"], span["stop"]])
            reached, pieces = 0, []
            for start, stop in merged:
                pieces.append(raw[reached:start])
                reached = stop
            kept.append(b"".join([*pieces, raw[reached:]]))
            runs.append([{"start": start, "stop": stop} for start, stop in merged])
        yield pa.RecordBatch.from_arrays(
            [block.batch.column(0), block.batch.column(1), pa.array(runs, pa.list_(_SPAN)), pa.array(kept, pa.binary())],
            ["id", "text", "runs", "kept"],
        )


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; strings of 200 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    removed = F.expr("aggregate(runs, 0L, (sum, run) -> sum + run.stop - run.start)")
    return remove_repeats(docs).select(
        F.col("id").alias("doc_id"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("runs").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
