"""Personal data by rules and a semi-Markov conditional random field.

Fixed rules find what is certain.  Around everything that could be personal data the field
scores whole candidate spans: it cuts a stretch of text into atoms (digit runs, letter runs,
single marks) and chooses the best segmentation into spans of a kind and single atoms outside,
by dynamic programming over spans of bounded length.  Spans of the rules stay; the field adds
spelled-out, reformatted and unprefixed ones that do not touch them.

The field is trained on a bounded sample of stretches.  The rules label them, and copies in the
other usual notations are labelled alike.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.words import BLOCK_BYTES
from plumbline.storage import settle

KINDS = ("email", "ip", "card", "phone")
# Stretches of text the field is trained on, at most.
TRAINING_STRETCHES = 1_500
# Characters of a training stretch, and atoms of a span, at most.
_STRETCH = 160
_LONGEST = 48
_ROUNDS = 12
_MARGIN = 1.0

# The rules.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Texts without any of these hold nothing to find.
_WORTH_A_LOOK = r"[0-9@]|[\[({] ?(?:at|AT|dot|DOT) ?[\])}]| (?:dot|DOT) "
_AT = r"(?:@| ?[\[({] ?(?:at|AT) ?[\])}] ?| (?:at|AT) )"
_DOT = r"(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?| (?:dot|DOT) )"
_SPELLED = re.compile(
    rf"[A-Za-z0-9_%+-]{{1,64}}(?:\.[A-Za-z0-9_%+-]{{1,64}}){{0,4}}{_AT}"
    rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}"
)
_NUMBERS = re.compile(r"(?:\+ ?)?\(?[0-9](?:[\x20().,/:-]{0,3}[0-9])*")
# What looks alike and is none; every # is a digit.
_DECOYS = (
    "on ####-##-## at ##:##:##, see", "ISBN 978-#-##-######-# and", "sum of #,###,###.## paid",
    "pages ####-####, ####-####.", "key ####.####.####.#### end", "go # at # dot # now",
    "version #.##.### of", "number ########### in", "see it at point dot com plex", "ratio ##.####:##.#### is",
    "meet at noon dot", "####/##/## ####/##/##", "lot ###-####-###-## x", "# ## ### #### ##### ###### ####",
)
_DECOY_COPIES = 12
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the rules' matches, sorted; linear in the text."""
    found = []
    reached, place = 0, text.find("@")
    while place >= 0:
        run = text[reached:place]
        local = len(run) - len(run.rstrip(_LOCAL))
        match = _DOMAIN.match(text, place) if local else None
        reached = match.end() if match else place + 1
        if match:
            found.append((place - local, 0, reached))
        place = text.find("@", reached)
    for match in _DOTTED.finditer(text):
        if "." not in match[0]:
            continue
        parts, start = match[0].split("."), match.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(map(_small, four)):
                found.append((start, 1, end))
            start = end + 1
    for match in _SPACED.finditer(text):
        digits = _digits(match[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((match.start(), 2, match.end()))
    for match in _PLUS.finditer(text):
        if 10 <= len(_digits(match[0])) <= 15:
            found.append((match.start(), 3, match.end()))
    return sorted(found)


def stretches(text: str) -> list[tuple[int, int]]:
    """Bounds of what may hold personal data, disjoint and in order."""
    bounds = [m.span() for m in _NUMBERS.finditer(text) if m.end() - m.start() > 6]
    if re.search(rf"{_AT}", text):
        bounds += [m.span() for m in _SPELLED.finditer(text)]
    merged: list[list[int]] = []
    for start, end in sorted(bounds):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end])
    return [(start, end) for start, end in merged]


@dataclass
class Lattice:
    """A stretch's atoms and its candidate spans with their features."""

    bounds: list[int]
    spans: list[tuple[int, int]]
    features: np.ndarray


_PATTERNS = [
    re.compile(p)
    for p in (
        r"[^@]+@[^@]+\.[A-Za-z]{2,8}",
        rf"[A-Za-z0-9._%+-]+ ?[\[({{] ?(?:at|AT) ?[\])}}] ?[A-Za-z0-9-]+{_DOT}.*[A-Za-z]{{2,8}}",
        rf"[A-Za-z0-9._%+-]+ (?:at|AT) [A-Za-z0-9-]+(?: (?:dot|DOT) [A-Za-z0-9-]+)* (?:dot|DOT) [A-Za-z]{{2,8}}",
        r".*[@]",
        r"[^0-9]*",
        r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
        r"[0-9]+(?:\.[0-9]+){1,2}",
        r"\+.*",
        r"\+?[0-9]{0,3}[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}",
        r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}",
        r"[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}",
        r"[0-9]+",
        r"[0-9 -]+",
        r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}.*",
        r".*[,/:].*",
        r".*[ ]{2}.*",
        r".*[A-Za-z].*",
    )
]
N_FEATURES = len(_PATTERNS) + 12


def _features(text: str, start: int, end: int) -> np.ndarray:
    """Whole-span features, and of what stands next to the span."""
    span = text[start:end]
    digits = _digits(span)
    count = len(digits)
    before, after = text[start - 1 : start], text[end : end + 1]
    dotted = span.split(".")
    values = [1.0, *(1.0 if p.fullmatch(span) else 0.0 for p in _PATTERNS)]
    values += [
        float(14 <= count <= 19 and luhn(digits)),
        float(14 <= count <= 19),
        float(10 <= count <= 15),
        float(7 <= count <= 9),
        float(count > 19 or 0 < count < 7),
        float(len(dotted) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in dotted)),
        float(before.isalnum() or before in ("_", "=", "#", "+")),
        float(after.isalnum() or after in ("_", "@")),
        float(bool(re.match(r"[ .()-]{0,2}[0-9]", text[end : end + 3]))),
        float(bool(re.search(r"[0-9][ .()+-]{0,2}$", text[max(start - 3, 0) : start]))),
        min(len(span), 40) / 40.0,
    ]
    return np.array(values)


def lattice(text: str, start: int, end: int, taken: Sequence[tuple[int, int]] = ()) -> Lattice:
    """Candidates: spans of at most so many atoms, from a letter, digit, ``+`` or ``(`` to a
    letter or digit, that hold an address sign or seven digits and touch nothing ``taken``."""
    starts, ends = [a for a, _ in taken] + [len(text) + 1], [b for _, b in taken]
    held = len(ends)

    def inside(place: int) -> bool:
        before = bisect_right(starts, place) - 1
        return 0 <= before < held and place < ends[before]

    atoms = [m.span() for m in _ATOM.finditer(text, start, end)]
    bounds = [a for a, _ in atoms] + [end]
    counts = np.concatenate([[0], np.cumsum([e - s if "0" <= text[s] <= "9" else 0 for s, e in atoms])])
    signs = np.concatenate(
        [[0], np.cumsum([text[s:e] == "@" or text[s:e].lower() == "at" for s, e in atoms])]
    )
    spans, rows = [], []
    for i, (a, _) in enumerate(atoms):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        stop = starts[bisect_right(starts, a)]
        if held and inside(a):
            continue
        for j in range(i + 1, min(i + _LONGEST, len(atoms)) + 1):
            b = atoms[j - 1][1]
            if b > stop:
                break
            number = counts[j] - counts[i]
            sign = signs[j] - signs[i]
            dotted = number >= 4 and text.count(".", a, b) == 3
            if text[b - 1].isalnum() and (sign == 1 or (not sign and (number >= 7 or dotted) and number <= 24)):
                spans.append((i, j))
                rows.append(_features(text, a, b))
    return Lattice(bounds, spans, np.array(rows).reshape(len(rows), N_FEATURES))


def _log_add(a: np.ndarray) -> float:
    top = a.max()
    return top + math.log(np.exp(a - top).sum())


def _expected(net: Lattice, scores: np.ndarray) -> np.ndarray:
    """Probability of every span and kind, by the forward and backward sums."""
    size = len(net.bounds) - 1
    by_end: list[list[int]] = [[] for _ in range(size + 1)]
    by_start: list[list[int]] = [[] for _ in range(size + 1)]
    for k, (i, j) in enumerate(net.spans):
        by_end[j].append(k)
        by_start[i].append(k)
    totals = np.logaddexp.reduce(scores, axis=1)
    forward, backward = np.zeros(size + 1), np.zeros(size + 1)
    for at in range(1, size + 1):
        terms = [forward[at - 1]] + [forward[net.spans[k][0]] + totals[k] for k in by_end[at]]
        forward[at] = _log_add(np.array(terms))
    for at in range(size - 1, -1, -1):
        terms = [backward[at + 1]] + [backward[net.spans[k][1]] + totals[k] for k in by_start[at]]
        backward[at] = _log_add(np.array(terms))
    starts = np.array([i for i, _ in net.spans])
    ends = np.array([j for _, j in net.spans])
    return np.exp(scores + (forward[starts] + backward[ends] - forward[size])[:, None])


def decode(net: Lattice, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation."""
    if not len(net.spans):
        return []
    scores = net.features @ weights.T - _MARGIN
    kinds = scores.argmax(axis=1)
    size = len(net.bounds) - 1
    best, back = np.zeros(size + 1), [None] * (size + 1)
    by_end: list[list[int]] = [[] for _ in range(size + 1)]
    for k, (i, j) in enumerate(net.spans):
        by_end[j].append(k)
    for at in range(1, size + 1):
        best[at] = best[at - 1]
        for k in by_end[at]:
            score = best[net.spans[k][0]] + scores[k, kinds[k]]
            if score > best[at]:
                best[at], back[at] = score, k
    found, at = [], size
    while at:
        k = back[at]
        if k is None:
            at -= 1
        else:
            i, j = net.spans[k]
            found.append((net.bounds[i], int(kinds[k]), net.bounds[j]))
            at = i
    return found[::-1]


def _variants(text: str, gold: list[tuple[int, int, int]]) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """The stretch, and copies with one span in another notation."""
    yield text, gold
    for start, kind, end in gold:
        span = text[start:end]
        digits = _digits(span)
        if kind == 0:
            name, host = span.split("@", 1)
            forms = [
                f"{name} at {host.replace('.', ' dot ')}",
                f"{name}[at]{host.replace('.', '[dot]')}",
                f"{name} (at) {host.replace('.', ' (dot) ')}",
                f"{name} [at] {host}",
            ]
        elif kind == 2:
            forms = [f"{digits[:4]}{s}{digits[4:8]}{s}{digits[8:12]}{s}{digits[12:]}" for s in (" ", ".", "-")]
        elif kind == 3:
            ten = digits[-10:]
            forms = [f"({ten[:3]}) {ten[3:6]}-{ten[6:]}", f"{ten[:3]}-{ten[3:6]}-{ten[6:]}", f"{ten[:3]}.{ten[3:6]}.{ten[6:]}"]
        else:
            forms = []
        for form in forms:
            yield text[:start] + form + text[end:], [(start, kind, start + len(form))]


def train(samples: list[tuple[str, list[tuple[int, int, int]]]]) -> np.ndarray | None:
    """Weights per kind by gradient ascent on the conditional likelihood; None without spans."""
    turn = np.random.default_rng(0)
    nets = []
    decoys = [
        (re.sub("#", lambda _: str(turn.integers(10)), decoy), [])
        for decoy in _DECOYS
        for _ in range(_DECOY_COPIES)
    ]
    for text, gold in [*samples, *decoys] if any(gold for _, gold in samples) else []:
        for form, spans in _variants(text, gold):
            where = [(a, b) for a, b in stretches(form)]
            for a, b in where:
                net = lattice(form, a, b)
                if not net.spans:
                    continue
                truth = np.zeros((len(net.spans), len(KINDS)))
                places = {(net.bounds[i], net.bounds[j]): k for k, (i, j) in enumerate(net.spans)}
                for start, kind, end in spans:
                    if (start, end) in places:
                        truth[places[start, end], kind] = 1.0
                nets.append((net, truth))
    if not any(truth.any() for _, truth in nets):
        return None
    weights = np.zeros((len(KINDS), N_FEATURES))
    seen = np.full_like(weights, 1e-6)
    for _ in range(_ROUNDS):
        for at in turn.permutation(len(nets)):
            net, truth = nets[at]
            scores = net.features @ weights.T
            slope = (truth - _expected(net, scores)).T @ net.features - 1e-4 * weights
            seen += slope**2
            weights += 0.3 * slope / np.sqrt(seen)
    return weights


def _looked_at(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of batches with their texts; None where a text holds nothing to find."""
    for batch in batches:
        start = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        reached = np.cumsum(sizes)
        while start < batch.num_rows:
            done = reached[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(reached, done + BLOCK_BYTES, "right")))
            part = batch.slice(start, min(stop, batch.num_rows) - start)
            worth = pc.fill_null(pc.match_substring_regex(part.column(at), _WORTH_A_LOOK), False)
            texts: list[str | None] = [None] * part.num_rows
            for i, text in zip(np.flatnonzero(worth.to_numpy(zero_copy_only=False)), part.column(at).filter(worth).to_pylist()):
                texts[i] = text
            yield part, texts
            start = min(stop, batch.num_rows)


def fit_field(docs: DataFrame, text_column: str = "text", sample: int = TRAINING_STRETCHES) -> np.ndarray | None:
    """Trains the field on at most ``sample`` distinct stretches: equal shares with each kind of
    datum and without any, then of all kinds, those with the smallest hashes of each."""

    def run(batches):
        for part, texts in _looked_at(batches, 1):
            stretch, gold = [], []
            for text in texts:
                if text is None:
                    continue
                spans = rule_spans(text)
                for start, end in stretches(text):
                    low, high = max(start - 12, 0), end + 12
                    if end - start > _STRETCH:
                        continue
                    inside = [(a - low, k, b - low) for a, k, b in spans if start <= a and b <= end]
                    if any(a < high and low < b and not (start <= a and b <= end) for a, _, b in spans):
                        continue
                    stretch.append(text[low:high])
                    gold.append(",".join(f"{a}:{k}:{b}" for a, k, b in inside))
            yield pa.RecordBatch.from_arrays([pa.array(stretch, pa.string()), pa.array(gold, pa.string())], ["stretch", "gold"])

    texts = docs.select(F.lit(0).alias("none"), F.col(text_column).cast("string").alias("text"))
    found = settle(texts.mapInArrow(run, "stretch string, gold string").distinct(), "stretches")
    order = [F.xxhash64("stretch"), "stretch", "gold"]
    kinds = [F.col("gold") == "", *[F.col("gold").contains(f":{kind}:") for kind in range(len(KINDS))]]
    rows: dict = {}
    for chosen, bound in [*((kind, sample // (len(kinds) + 1)) for kind in kinds), (F.lit(True), sample)]:
        # As many new ones as the share, and no more than the sample in all.
        limit = min(bound, sample - len(rows))
        for row in found.where(chosen).orderBy(*order).limit(sample).collect():
            if limit > 0 and row not in rows:
                rows[row] = None
                limit -= 1
    return train(
        [
            (row["stretch"], [tuple(map(int, span.split(":"))) for span in row["gold"].split(",") if span])
            for row in rows
        ]
    )


def all_spans(text: str, weights: np.ndarray | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The rules' spans, and these with what the field adds."""
    base = rule_spans(text)
    if weights is None:
        return base, base
    # The rules' spans of different kinds may overlap; what they cover is taken once.
    taken: list[tuple[int, int]] = []
    for start, _, end in base:
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    added, at = [], 0
    for start, end in stretches(text):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        last = at
        while last < len(taken) and taken[last][0] < end:
            last += 1
        if last == at or taken[at][0] > start or taken[at][1] < end:
            added += decode(lattice(text, start, end, taken[at:last]), weights)
    return base, sorted(base + added)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_personal_data(
    docs: DataFrame, weights: np.ndarray | None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` and ``spans`` as lists of
    ``kind:start:end`` (code points, end exclusive).

    A null text has no spans; a null id stays null; rows are reported each.  Only the listed two
    columns of ``docs`` are used."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for part, texts in _looked_at(batches, 1):
            found = [([], []) if text is None else all_spans(text, shared.value) for text in texts]
            lists = [pa.array([_listed(pair[k]) for pair in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["doc_id", "base", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, base string, spans string")


def redact(docs: DataFrame, weights: np.ndarray | None, text_column: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; of overlapping
    spans, one mark for each.  Null texts stay null, other columns stay as they are."""
    at = docs.columns.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for part, texts in _looked_at(batches, at):
            changed = part.column(at).to_pylist()
            for i, text in enumerate(texts):
                if text is None:
                    continue
                pieces, reached = [], 0
                for start, kind, end in all_spans(text, shared.value)[1]:
                    pieces += [text[reached:start], f"[{KINDS[kind].upper()}]"]
                    reached = max(reached, end)
                changed[i] = "".join([*pieces, text[reached:]])
            columns = [pa.array(changed, pa.string()) if i == at else c for i, c in enumerate(part.columns)]
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_personal_data(docs, fit_field(docs))

    def number(kind: str):
        return F.size(F.filter(F.split("base", ","), lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(kind) for kind in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans"
    )
