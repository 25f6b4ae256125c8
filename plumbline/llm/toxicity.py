"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums over common subsequences of three characters, each weighted down by
the gaps it spans, so an insult with gaps or inserted characters stays close to the plain one.
Word starts and ends count as characters.  A document is labelled, not its words: training
alternates between fitting the machine on words and choosing the worst word of every toxic text
as its witness (multiple-instance training).

The machine works in the space spanned by landmark words.  Its decision is a sum over landmarks of
kernel values, hence a sum over a word's own subsequences of one table of weights; that table is
all a task needs, and a word's value is the same as through the landmarks.  A document's score is
that of its worst word, as a probability fitted on the training texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.words import blocks
from plumbline.storage import settle

# Labelled texts the machine is trained on, at most: those whose ids have the smallest hashes.
TOXIC_SAMPLE, CLEAN_SAMPLE = 3_000, 6_000
LANDMARKS = 400
PREDICTED_FROM = 0.7
_DECAY = 0.7
_SPAN = 5
_LONGEST = 24
_WITNESSES = 8
_NEGATIVES = 4_000
_ROUNDS = 3
_RIDGE = 1e-4
# Texts that must share a word before it can be a first witness.
_SUPPORT = 3
_BENT, _BENT_WEIGHT = 8, 0.3
_REMEMBERED = 400_000
_NOTHING = -3.0

_PART = re.compile(r"[^\W_]+")
_JOINED = re.compile(r"[^\W_]+(?:(?:[^\w\s]|_)+[^\W_]+)+")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[^\S\n][^\W_]){2,}(?!\S)")
_MARKS = re.compile(r"[\W_]+")
# Three stretches of one character.
_ALONE = b"\1\1\1"
# Characters of a stretch that is remembered whole.
_HELD = 80

# Pairs of gaps of a subsequence's three characters.
_GAPS = [(a, b) for a in range(1, _SPAN) for b in range(1, _SPAN) if a + b <= _SPAN]
_CODES = 64
_FEATURES = _CODES**3
_START, _STOP = 37, 38


def _code_table() -> np.ndarray:
    table = 39 + np.arange(0x110000) % 25
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    table[ord("0") : ord("9") + 1] = np.arange(27, 37)
    return table.astype(np.int32)


def units(text: str) -> list[str]:
    """Words of a text in lower case; words broken by marks or spelled with spaces also as one;
    overlong ones as overlapping pieces."""
    text = text.lower()
    found = _PART.findall(text)
    found += [_MARKS.sub("", joined) for joined in _JOINED.findall(text)]
    found += [_MARKS.sub("", spelled) for spelled in _SPACED.findall(text)]
    return _pieces(found)


def stretch_units(stretch: str) -> list[str]:
    """``units`` of a lower-case text without white space: its parts, and all of them joined."""
    if stretch.isalnum():
        return [stretch] if len(stretch) <= _LONGEST else _pieces([stretch])
    found = _PART.findall(stretch)
    if len(found) > 1:
        found.append("".join(found))
    return _pieces(found)


def _pieces(found: list[str]) -> list[str]:
    if max(map(len, found), default=0) > _LONGEST:
        step = _LONGEST // 2
        found = [
            piece
            for unit in found
            for piece in (
                [unit]
                if len(unit) <= _LONGEST
                else [unit[i : i + _LONGEST] for i in range(0, len(unit) - step, step)]
            )
        ]
    return found


@dataclass(frozen=True)
class Features:
    """Subsequences of words: row ``i`` holds ``codes[starts[i]:starts[i + 1]]``, each once."""

    codes: np.ndarray
    values: np.ndarray
    rows: np.ndarray
    norms: np.ndarray


def subsequences(words: list[str], table: np.ndarray) -> Features:
    lengths = np.array([len(word) for word in words], np.int64)
    width = int(lengths.max(initial=0)) + 2 + _SPAN
    grid = np.zeros((len(words), width), np.int32)
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    rows = np.repeat(np.arange(len(words)), lengths)
    columns = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grid[rows, columns + 1] = table[points]
    grid[:, 0] = _START
    grid[np.arange(len(words)), lengths + 1] = _STOP
    inner = width - _SPAN
    packed = []
    for a, b in _GAPS:
        first, second, third = grid[:, :inner], grid[:, a : a + inner], grid[:, a + b : a + b + inner]
        code = ((first * _CODES + second) * _CODES + third) * 8 + (a + b)
        packed.append(np.where(third > 0, code, 0))
    packed = np.concatenate(packed, axis=1)
    packed.sort(axis=1)
    real = packed > 0
    flat, rows = packed[real], np.broadcast_to(np.arange(len(words))[:, None], packed.shape)[real]
    codes, weights = flat >> 3, _DECAY ** ((flat & 7) - 2.0)
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
    group = np.cumsum(new) - 1
    values = np.bincount(group, weights, int(new.sum()))
    codes, rows = codes[new], rows[new]
    norms = np.sqrt(np.bincount(rows, values**2, len(words)))
    return Features(codes, values, rows, np.maximum(norms, 1e-12))


@dataclass(frozen=True)
class Machine:
    """``table`` weighs subsequences, ``slope`` and ``shift`` turn a value into a probability."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def values(self, words: list[str], codes: np.ndarray) -> np.ndarray:
        if not words:
            return np.empty(0)
        found = subsequences(words, codes)
        sums = np.bincount(found.rows, self.table[found.codes] * found.values, len(words))
        return sums / found.norms + self.bias

    def probability(self, values: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * values + self.shift, -50, 50)))


class Scorer:
    """Values of the worst words of texts; remembers the worst of recent stretches without space.

    No word but a spelled one holds a space, so a text's words are those of its stretches and, if
    three stretches of one character stand in a row, the spelled ones."""

    def __init__(self, machine: Machine):
        self.machine, self.codes, self.known, self.values = machine, _code_table(), {}, {}

    def _learn(self, stretches: list[str]) -> None:
        if len(self.values) > _REMEMBERED:
            self.values = {}
        values = self.values
        each = list(map(stretch_units, stretches))
        new = list({unit: None for found in each for unit in found if unit not in values})
        for start in range(0, len(new), 5_000):
            part = new[start : start + 5_000]
            values.update(zip(part, self.machine.values(part, self.codes).tolist()))
        for stretch, found in zip(stretches, each):
            self.known[stretch] = (
                values[found[0]] if len(found) == 1 else max(map(values.__getitem__, found), default=-np.inf)
            )

    def worst(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > _REMEMBERED:
            self.known = {}
        known = self.known
        split = []
        for text in texts:
            text = text.lower()
            stretches = text.split()
            found, sizes = set(stretches), list(map(len, stretches))
            if _ALONE in bytes([size < 2 for size in sizes]):
                # What comes back is in lower case and without marks, hence one stretch.
                found.update(_MARKS.sub("", spelled) for spelled in _SPACED.findall(text))
            if max(sizes, default=0) > _HELD:
                # A word is a stretch of its own.
                long = [stretch for stretch in found if len(stretch) > _HELD]
                found.difference_update(long)
                found.update(unit for stretch in long for unit in stretch_units(stretch))
            split.append(found)
        self._learn(list({stretch: None for each in split for stretch in each if stretch not in known}))
        values = np.array([max(map(known.__getitem__, each), default=-np.inf) for each in split])
        return np.where(values == -np.inf, _NOTHING, values)


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """The normalized kernel of every word of one list with every one of the other."""
    codes = _code_table()
    a, b = subsequences(left, codes), subsequences(right, codes)
    shared, at = np.unique(b.codes, return_inverse=True)
    dense = np.zeros((len(right), len(shared)))
    dense[b.rows, at] = b.values / b.norms[b.rows]
    place = np.minimum(np.searchsorted(shared, a.codes), max(len(shared) - 1, 0))
    there = shared[place] == a.codes
    out = np.zeros((len(left), len(right)))
    for start in range(0, len(left), 256):
        chosen = there & (a.rows >= start) & (a.rows < start + 256)
        rows = np.zeros((min(256, len(left) - start), len(shared)))
        rows[a.rows[chosen] - start, place[chosen]] = (a.values / a.norms[a.rows])[chosen]
        out[start : start + 256] = rows @ dense.T
    return out


def bent(word: str) -> list[str]:
    """The word with one character inserted or doubled inside, at places its own letters pick."""
    turn = np.random.default_rng([ord(c) for c in word])
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    made = []
    for place in turn.permutation(np.arange(1, len(word)))[:_BENT].tolist():
        made.append(word[:place] + letters[int(turn.integers(len(letters)))] + word[place:])
        made.append(word[:place] + word[place - 1] + word[place:])
    return made


def train(positive: list[str], counts: list[int], negative: list[str]) -> Machine:
    """Squared-hinge machine over Nyström features of the landmarks, by Newton steps.

    Bent forms of the positive words count as positive, too, but less."""
    known = set(positive) | set(negative)
    bends = [(b, c) for word, c in zip(positive, counts) for b in bent(word) if b not in known]
    counts = [*counts, *(_BENT_WEIGHT * c for _, c in bends)]
    half = LANDMARKS // 2
    landmarks = positive[:half] + negative[: LANDMARKS - min(half, len(positive))]
    spectrum, basis = np.linalg.eigh(kernel(landmarks, landmarks))
    good = spectrum > 1e-6 * spectrum.max()
    whiten = basis[:, good] / np.sqrt(spectrum[good])
    positive = positive + [b for b, _ in bends]
    words = positive + negative
    x = np.c_[kernel(words, landmarks) @ whiten, np.ones(len(words))]
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weight = np.r_[np.sqrt(np.array(counts, float)), np.ones(len(negative))]
    weight[: len(positive)] *= 0.5 / weight[: len(positive)].sum()
    weight[len(positive) :] *= 0.5 / max(weight[len(positive) :].sum(), 1e-12)
    ridge = np.full(x.shape[1], _RIDGE)
    ridge[-1] = 1e-9
    solution = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ solution) < 1
        heavy = x[active] * weight[active, None]
        solved = np.linalg.solve(heavy.T @ x[active] + np.diag(ridge), heavy.T @ y[active])
        moved = np.abs(solved - solution).max()
        solution = solution + 0.8 * (solved - solution)
        if moved < 1e-6:
            break
    alpha = whiten @ solution[:-1]
    own = subsequences(landmarks, _code_table())
    table = np.bincount(own.codes, own.values / own.norms[own.rows] * alpha[own.rows], _FEATURES)
    return Machine(table, float(solution[-1]))


def _platt(values: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a probability, with the usual softened targets."""
    ups, downs = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (ups + 1) / (ups + 2), 1 / (downs + 2))
    x = np.c_[values, np.ones(len(values))]
    solution = np.array([1.0, 0.0])
    for _ in range(60):
        chance = 1 / (1 + np.exp(-np.clip(x @ solution, -50, 50)))
        slope = x.T @ (chance - target) + 1e-6 * solution
        curve = (x * (chance * (1 - chance) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        solution = solution - step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(solution[0]), float(solution[1])


def _sample(labelled: DataFrame) -> DataFrame:
    """Ids and labels of the training texts; both bounds are parameters of this module."""
    order = [F.xxhash64("id"), "id"]
    toxic = labelled.where("toxic = 1").orderBy(*order).limit(TOXIC_SAMPLE)
    clean = labelled.where("toxic = 0").orderBy(*order).limit(CLEAN_SAMPLE)
    return toxic.unionAll(clean)


def _words(batches):
    """Different words of each text."""
    for block in blocks(batches, "text"):
        texts = block.batch.column(2).to_pylist()
        each = [sorted(set(units(text or ""))) for text in texts]
        sizes = np.array([len(words) for words in each])
        yield pa.RecordBatch.from_arrays(
            [
                block.batch.column(0).take(pa.array(np.repeat(np.arange(len(each)), sizes))),
                block.batch.column(1).take(pa.array(np.repeat(np.arange(len(each)), sizes))),
                pa.array([word for words in each for word in words], pa.string()),
            ],
            ["id", "toxic", "word"],
        )


def _values_of(machine: Machine, words: DataFrame) -> DataFrame:
    shared = words.sparkSession.sparkContext.broadcast((machine.table, machine.bias))

    def run(batches):
        machine, codes = Machine(*shared.value), _code_table()
        for batch in batches:
            for start in range(0, batch.num_rows, 5_000):
                part = batch.slice(start, 5_000)
                values = machine.values(part.column(0).to_pylist(), codes)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], ["word", "value"])

    return words.mapInArrow(run, "word string, value double")


def fit_machine(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic"
) -> Machine | None:
    """Trains on the texts of the labelled ids, each different text once; None without both kinds,
    or if no three toxic texts share a word.

    Null ids and labels are left out; an id labelled more than once has its highest label."""
    labelled = (
        labels.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("int").alias("toxic"))
        .where("id is not null and toxic in (0, 1)")
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    sample = F.broadcast(_sample(labelled))
    chosen = texts.where("text is not null").join(sample, "id").select("id", "toxic", "text")
    chosen = settle(chosen.dropDuplicates(["text", "toxic"]), "labelled")
    words = settle(chosen.mapInArrow(_words, "id long, toxic int, word string"), "words")
    sizes = {row["toxic"]: row["count"] for row in chosen.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    stats = settle(
        words.groupBy("word").agg(F.sum("toxic").alias("up"), F.sum(1 - F.col("toxic")).alias("down")), "stats"
    )
    odds = F.expr(f"(up + 0.5D) / {sizes[1] + 1} / ((down + 0.5D) / {sizes[0] + 1})")
    ranked = Window.partitionBy("id").orderBy(F.desc("odds"), "word")
    bags: dict[int, list[tuple[str, float, int]]] = {}
    suspects = (
        words.where("toxic = 1").join(stats.withColumn("odds", odds), "word")
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= _WITNESSES)
    )
    for row in suspects.orderBy("id", "rank").collect():
        bags.setdefault(row["id"], []).append((row["word"], row["odds"], row["up"]))
    clean = stats.withColumn("odds", odds).where("down > 0 and odds < 2").drop("odds")
    often = clean.orderBy(F.desc("down"), "word").limit(_NEGATIVES // 4)
    spread = clean.orderBy(F.xxhash64("word"), "word").limit(_NEGATIVES)
    negative = [row["word"] for row in spread.union(often).select("word").distinct().orderBy(F.xxhash64("word")).collect()]
    witnesses = [each[0][0] for each in bags.values() if each[0][2] >= _SUPPORT]
    if not witnesses:
        return None
    machine = None
    codes = _code_table()
    for _ in range(_ROUNDS):
        forms: dict[str, int] = {}
        for word in witnesses:
            forms[word] = forms.get(word, 0) + 1
        positive = sorted(forms, key=lambda word: (-forms[word], word))
        machine = train(positive, [forms[word] for word in positive], [w for w in negative if w not in forms])
        hardest = _values_of(machine, clean.select("word")).orderBy(F.desc("value"), "word").limit(_NEGATIVES // 4)
        hard = [row["word"] for row in hardest.collect()]
        negative = hard + [word for word in negative if word not in set(hard)]
        witnesses = []
        for each in bags.values():
            values = machine.values([word for word, _, _ in each], codes)
            worst = int(np.argmax(values + 0.1 * np.log([odds for _, odds, _ in each])))
            # A text without a word like the others' is taken for a mislabelled one.
            if values[worst] > 0:
                witnesses.append(each[worst][0])
    judged = _worst_values(chosen, machine).join(chosen.select("id", "toxic"), "id").collect()
    # Bent witnesses are as toxic as plain ones, or the probability would ask for the plain form;
    # a quarter as many as there are toxic texts.
    bends = [b for word in positive for b in bent(word)]
    bends = machine.values(bends[:: max(1, 4 * len(bends) // sizes[1])], codes)
    slope, shift = _platt(
        np.r_[[row["value"] for row in judged], bends],
        np.r_[[row["toxic"] == 1 for row in judged], np.ones(len(bends), bool)],
    )
    return Machine(machine.table, machine.bias, slope, shift)


def _worst_values(texts: DataFrame, machine: Machine) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((machine.table, machine.bias))

    def run(batches):
        scorer = Scorer(Machine(*shared.value))
        for block in blocks(batches, "text"):
            texts = pc.fill_null(block.batch.column(1), "").to_pylist()
            yield pa.RecordBatch.from_arrays([block.batch.column(0), pa.array(scorer.worst(texts))], ["id", "value"])

    return texts.select("id", "text").mapInArrow(run, "id long, value double")


def score_toxicity(
    docs: DataFrame, machine: Machine | None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id`` and ``score`` (0 to 1) per row of ``docs``.  A text without words has the score of
    the mildest word; a null one counts as empty.  Without a machine every score is 0."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    if machine is None:
        return texts.select("id", F.lit(0.0).alias("score"))
    scaled = F.lit(machine.slope) * F.col("value") + F.lit(machine.shift)
    return _worst_values(texts, machine).select("id", (1 / (1 + F.exp(-scaled))).alias("score"))


def _turn(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def op8_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; labels of a third of the ids are not seen."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_turn("doc_id") != 1)
    scored = score_toxicity(docs, fit_machine(docs, labels))
    return scored.select(
        F.col("id").alias("doc_id"),
        F.coalesce(_turn("id") == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"),
    )
