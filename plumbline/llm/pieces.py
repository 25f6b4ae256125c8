"""SentencePiece encoding and decoding by an Aho-Corasick automaton in a single pass.

The automaton holds all pieces of a given model.  Reading a text once, every position follows
the output links from the current state, longest piece first.  For a model of piece probabilities
this relaxes the best score of a segmentation that ends there (Viterbi).  For a BPE model scores
are merge ranks, whose sums mean nothing: there the piece that ends the encoding of the text so far
is the only one that merging leaves apart from the last piece before it, and that is asked of the
two pieces' merges.  Characters without a piece become byte pieces, so that decoding gives the text
back exactly.

No piece goes beyond a word's end, which is checked when a model is loaded, so the best
segmentation of a text is that of its words.  A task runs the automaton over many different words
at once, one position of all of them per step, and keeps the pieces of recent words.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.words import blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
# Words whose pieces a task remembers, at most.
_REMEMBERED = 150_000
# The format's mark of a space, and what a character without a piece costs.
_SPACE_MARK = "▁"
_UNKNOWN_PENALTY = 10.0
_WORDS = re.compile(r" *[^ \n]+| +|\n")
_WHOLE = re.compile(r"(?s).+")


@dataclass(frozen=True)
class Merges:
    """Arrays over pieces: rank of the merge that makes one (-1 for characters, -2 for pieces that
    no text is merged to) and the parts it merges; and the sorted pairs that merge, with ranks."""

    ranks: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray
    pair_ranks: np.ndarray

    def apart(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces' text gives just these: their merges are taken back,
        the latest first, and no earlier one may be possible across the place between them."""
        found = np.ones(len(first), bool)
        waiting, limit = np.arange(len(first)), np.full(len(first), np.iinfo(np.int64).max)
        while len(waiting):
            keys = first * len(self.ranks) + second
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            across = (self.pairs[place] == keys) & (self.pair_ranks[place] < limit)
            found[waiting[across]] = False
            going = ~across & ((self.ranks[first] >= 0) | (self.ranks[second] >= 0))
            waiting, first, second = waiting[going], first[going], second[going]
            a, b = self.ranks[first], self.ranks[second]
            # Of equal ranks the one further left is merged first.
            later = a > b
            limit = np.where(later, a, b + 1)
            first, second = np.where(later, self.right[first], first), np.where(later, second, self.left[second])
        return found


def find_merges(pieces: list[str], scores: list[float], matched: list[bool]) -> Merges:
    """The merges of a BPE model: best score first, leftmost among equal ones."""
    numbers = {p: i for i, p in enumerate(pieces) if matched[i]}
    if missing := {c for p in numbers for c in p if c not in numbers}:
        raise ValueError(f"characters of pieces are no pieces: {sorted(missing)[:5]}")
    long = {p: i for p, i in numbers.items() if len(p) > 1}
    order = {score: rank for rank, score in enumerate(sorted({scores[i] for i in long.values()}, reverse=True))}
    ranks = np.full(len(pieces), -2, np.int64)
    left, right = np.arange(len(pieces)), np.arange(len(pieces))
    for piece, i in numbers.items():
        if len(piece) == 1:
            ranks[i] = -1
            continue
        parts = list(piece)
        while len(parts) > 1:
            steps = [
                (order[scores[long[a + b]]], k)
                for k, (a, b) in enumerate(zip(parts, parts[1:]))
                if a + b in long
            ]
            if not steps:
                break
            _, k = min(steps)
            last = parts[k : k + 2]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 1:
            ranks[i] = order[scores[i]]
            left[i], right[i] = numbers[last[0]], numbers[last[1]]
    made = np.flatnonzero(ranks >= 0)
    if (np.maximum(ranks[left[made]], ranks[right[made]]) > ranks[made]).any():
        raise ValueError("a piece is ranked before its parts")
    keys = left[made] * len(pieces) + right[made]
    sort = np.argsort(keys)
    return Merges(ranks, left, right, keys[sort], ranks[made][sort])


@dataclass(frozen=True)
class Automaton:
    """Arrays over states: edges sorted by ``state * alphabet + character``, failure links, the
    piece that ends in a state (or -1), and the next state down the failure path with one."""

    characters: np.ndarray  # code point -> number of the character, 0 for unknown ones
    alphabet: int
    edges: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    piece: np.ndarray
    output: np.ndarray
    scores: np.ndarray
    lengths: np.ndarray
    unknown: float
    byte_ids: np.ndarray
    spelled: list[bytes]
    by_words: bool
    merges: Merges | None = None

    def step(self, states: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The states after reading one character each."""
        reached = np.zeros(len(states), np.int64)
        waiting, at = np.arange(len(states)), states
        while len(waiting):
            keys = at * self.alphabet + characters[waiting]
            place = np.minimum(np.searchsorted(self.edges, keys), len(self.edges) - 1)
            there = self.edges[place] == keys
            reached[waiting[there]] = self.targets[place[there]]
            going = ~there & (at != 0)
            waiting, at = waiting[going], self.fail[at[going]]
        return reached


def build_automaton(
    pieces: list[str], scores: list[float], matched: list[bool], byte_ids: list[int]
) -> Automaton:
    """``matched`` says which pieces texts may contain; ``byte_ids`` are the pieces of the 256 bytes."""
    numbers = {c: i for i, c in enumerate(sorted({c for p, m in zip(pieces, matched) if m for c in p}), 1)}
    codes = np.zeros(0x110000, np.int32)
    for character, number in numbers.items():
        codes[0x20 if character == _SPACE_MARK else ord(character)] = number
    if _SPACE_MARK in numbers:
        # The mark itself in a text is spelled in bytes, or decoding would make it a space.
        codes[ord(_SPACE_MARK)] = 0
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for i, piece in enumerate(pieces):
        if not matched[i]:
            continue
        state = 0
        for character in piece:
            state = children[state].setdefault(numbers[character], len(children))
            if state == len(children):
                children.append({})
                ends.append(-1)
        ends[state] = i
    fail, output = [0] * len(children), [0] * len(children)
    queue = deque(children[0].values())
    while queue:
        state = queue.popleft()
        for character, target in children[state].items():
            queue.append(target)
            down = fail[state]
            while down and character not in children[down]:
                down = fail[down]
            fail[target] = children[down].get(character, 0)
            output[target] = fail[target] if ends[fail[target]] >= 0 else output[fail[target]]
    alphabet = len(numbers) + 1
    edges = sorted((s * alphabet + c, t) for s, each in enumerate(children) for c, t in each.items())
    spelled = [p.replace(_SPACE_MARK, " ").encode() for p in pieces]
    for byte, i in enumerate(byte_ids):
        spelled[i] = bytes([byte])
    texts = [p for p, m in zip(pieces, matched) if m]
    return Automaton(
        codes,
        alphabet,
        np.array([e for e, _ in edges], np.int64),
        np.array([t for _, t in edges], np.int64),
        np.array(fail, np.int64),
        np.array(ends, np.int64),
        np.array(output, np.int64),
        np.array(scores, np.float64),
        np.array([len(p) for p in pieces], np.int64),
        min(scores) - _UNKNOWN_PENALTY,
        np.array(byte_ids, np.int32),
        spelled,
        not any(_SPACE_MARK in p.lstrip(_SPACE_MARK) or "\n" in p for p in texts),
    )


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protobuf message's fields."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        if key & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def _model_type(raw: bytes) -> int:
    """``trainer_spec.model_type`` of a model: 1 for piece probabilities, 2 for BPE."""
    trainer = dict(_fields(dict(_fields(raw)).get(2, b"")))
    return trainer.get(3, 1)


def load_model(path: str = MODEL) -> Automaton:
    """Reads a SentencePiece model with byte pieces and no normalization, on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in ids]
    byte_ids = [model.piece_to_id(f"<0x{byte:02X}>") for byte in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte pieces")
    scores = [model.get_score(i) for i in ids]
    matched = [not special[i] and not model.is_byte(i) for i in ids]
    automaton = build_automaton(pieces, scores, matched, byte_ids)
    kind = _model_type(model.serialized_model_proto())
    if kind not in (1, 2):
        raise ValueError("the model is neither of piece probabilities nor of merges")
    return replace(automaton, merges=find_merges(pieces, scores, matched)) if kind == 2 else automaton


def segment(
    automaton: Automaton, words: list[str], merges: Merges | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all words end to end, and where each word's begin: by ``merges`` or, without
    them, by the best sum of scores."""
    lengths = np.array([len(word) for word in words], np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    points = np.frombuffer("".join([words[i] for i in order]).encode("utf-32-le"), np.uint32)
    codes = automaton.characters[points]
    first = np.cumsum(lengths) - lengths
    # Scores and last pieces at the places between characters, one more than characters a word.
    origin = first + np.arange(len(words))
    best = np.zeros(len(points) + len(words))
    back = np.full(len(points) + len(words), -1, np.int64)
    states = np.zeros(len(words), np.int64)
    for t in range(int(lengths[0]) if len(words) else 0):
        active = int(np.searchsorted(-lengths, -t, "left"))
        states = automaton.step(states[:active], codes[first[:active] + t])
        here = origin[:active] + t + 1
        best[here] = best[here - 1] + automaton.unknown
        ending = np.where(automaton.piece[states] >= 0, states, automaton.output[states])
        place = here
        while len(ending := ending[keep := ending > 0]):
            place = place[keep]
            piece = automaton.piece[ending]
            if merges is not None:
                last = back[place - automaton.lengths[piece]]
                fits = merges.ranks[piece] >= -1
                asked = np.flatnonzero(fits & (last >= 0))
                fits[asked] = merges.apart(last[asked], piece[asked])
                back[place[fits]] = piece[fits]
                ending = np.where(fits, 0, automaton.output[ending])
                continue
            score = best[place - automaton.lengths[piece]] + automaton.scores[piece]
            better = score > best[place]
            best[place[better]] = score[better]
            back[place[better]] = piece[better]
            ending = automaton.output[ending]
    # Back from the ends; characters without a piece are noted by their place.
    owners, ids = [], []
    at, left = origin + lengths, np.arange(len(words))
    while len(left := left[at[left] > origin[left]]):
        place = at[left]
        piece = back[place]
        character = place - 1 - left
        owners.append(left)
        ids.append(np.where(piece >= 0, piece, -1 - character))
        at[left] -= np.where(piece >= 0, automaton.lengths[piece], 1)
    owner = np.concatenate([np.empty(0, np.int64), *owners[::-1]])
    found = np.concatenate([np.empty(0, np.int64), *ids[::-1]])
    sort = np.argsort(order[owner], kind="stable")
    owner, found = order[owner[sort]], found[sort]
    unknown = np.flatnonzero(found < 0)
    spelled = [chr(points[-1 - found[i]]).encode() for i in unknown]
    widths = np.ones(len(found), np.int64)
    widths[unknown] = [len(s) for s in spelled]
    out = np.repeat(found, widths)
    if len(unknown):
        starts = np.cumsum(widths) - widths
        places = np.concatenate([np.arange(len(s)) + starts[i] for i, s in zip(unknown, spelled)])
        out[places] = automaton.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    counts = np.bincount(owner, widths, len(words)).astype(np.int64)
    return out.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


class Encoder:
    """Encodes texts by the best sum of scores and remembers the pieces of recent words."""

    merges: Merges | None = None

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.pattern = _WORDS if automaton.by_words else _WHOLE
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.starts: list[np.ndarray] = []
        self.held = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each begins.  A text is read with a space
        before it; an empty one has no pieces."""
        if len(self.numbers) > _REMEMBERED:
            self._forget()
        words = [self.pattern.findall(" " + text) if text else [] for text in texts]
        numbers, new = self.numbers, {}
        for each in words:
            for word in each:
                if word not in numbers:
                    numbers[word] = len(numbers)
                    new[word] = None
        if new:
            ids, starts = segment(self.automaton, list(new), self.merges)
            self.ids.append(ids)
            self.starts.append(starts[:-1] + self.held)
            self.held += len(ids)
            self.ids = [np.concatenate(self.ids)]
            self.starts = [np.concatenate(self.starts)]
        if not numbers:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        ids, starts = self.ids[0], self.starts[0]
        lengths = np.diff(np.append(starts, self.held))
        used = np.array([numbers[word] for each in words for word in each], np.int64)
        counts = lengths[used]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        places = np.arange(total) + np.repeat(starts[used] - (ends - counts), counts)
        per_text = np.cumsum([0, *(len(each) for each in words)])
        return ids[places], np.concatenate([[0], ends])[per_text]


class MergeEncoder(Encoder):
    """Encodes texts by the merges of a BPE model."""

    def __init__(self, automaton: Automaton):
        super().__init__(automaton)
        self.merges = automaton.merges


def decode_ids(spelled: list[bytes], ids: list[int]) -> str:
    """The text of a list of ids; ids outside the model are left out."""
    size = len(spelled)
    return b"".join([spelled[i] for i in ids if 0 <= i < size]).decode("utf-8", "replace").removeprefix(" ")


def encode(
    docs: DataFrame, automaton: Automaton, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id`` and ``pieces`` (list of ids) per row of ``docs``: the model's own encoding, but for
    the mark of a space itself in a text, which is spelled in bytes.

    Null and empty texts have no pieces.  Rows are encoded each, null ids stay null, and other
    columns of ``docs`` are not used."""
    return _encoded(docs, automaton, id_column, text_column, False)


def round_trip(
    docs: DataFrame, automaton: Automaton, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``encode`` with ``decoded_sha256``, the hash of the UTF-8 text that the pieces decode to, made
    in the same pass from the bytes that the pieces spell."""
    return _encoded(docs, automaton, id_column, text_column, True)


def spell_all(spelled: np.ndarray, offsets: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The bytes of each list of ids; ``spelled`` are those of all pieces end to end."""
    lengths = np.diff(offsets)[ids]
    ends = np.cumsum(lengths)
    places = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(offsets[ids] - (ends - lengths), lengths)
    whole = spelled[places].tobytes()
    bounds = np.concatenate([[0], ends])[starts].tolist()
    return [whole[a:b] for a, b in zip(bounds, bounds[1:])]


def _encoded(
    docs: DataFrame, automaton: Automaton, id_column: str, text_column: str, digests: bool
) -> DataFrame:
    # Plain arrays, so that tasks need no import of the package.
    merges = automaton.merges and vars(automaton.merges)
    shared = docs.sparkSession.sparkContext.broadcast(vars(automaton) | {"merges": merges})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        merges = held["merges"] and Merges(**held["merges"])
        net = Automaton(**held | {"merges": merges})
        encoder = MergeEncoder(net) if merges else Encoder(net)
        spelled = np.frombuffer(b"".join(net.spelled), np.uint8)
        offsets = np.cumsum([0, *map(len, net.spelled)])
        for block in blocks(batches, "text"):
            texts = pc.fill_null(block.batch.column(1), "").to_pylist()
            ids, starts = encoder.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            columns, names = [block.batch.column(0), lists], ["doc_id", "pieces"]
            if digests:
                # Decoded as ``decode_ids`` does, the space before a text left out.
                decoded = [b.decode("utf-8", "replace").removeprefix(" ") for b in spell_all(spelled, offsets, ids, starts)]
                hashes = [hashlib.sha256(text.encode()).hexdigest() for text in decoded]
                columns, names = [*columns, pa.array(hashes, pa.string())], [*names, "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, pieces array<int>" + ", decoded_sha256 string" * digests)


def decode(encoded: DataFrame, automaton: Automaton) -> DataFrame:
    """``encoded`` with the column ``text`` (replaced where there) decoded from ``pieces``.

    A null list gives a null text, an empty one an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(automaton.spelled)

    @F.pandas_udf("string")
    def spell(lists):
        return lists.map(lambda ids: None if ids is None else decode_ids(shared.value, ids.tolist()))

    return encoded.withColumn("text", spell("pieces"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """All documents encoded, with a digest of the text that their pieces decode to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = round_trip(docs, load_model(model))
    return found.select(
        "doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "decoded_sha256"
    )
