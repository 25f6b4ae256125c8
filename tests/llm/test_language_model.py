import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import empty, from_files, messy, words

pytest.importorskip("plumbline.llm")
from plumbline.llm import language_model as lm  # noqa: E402



def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def brute(rows):
    """The same model with plain dictionaries."""
    texts = [(i, [*words(t), None]) for i, t in rows]
    train = [w for i, w in texts if not held(i)]
    seen = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip([0, *t], t))
    contexts = collections.Counter(seen)
    contexts[0] = len(train)
    total, types = sum(seen.values()), len(seen)

    def unigram(count, n=total):
        return (count + 0.1) / (n + 0.1 * (types + 1))

    def band(word):
        return int(np.log2(max(contexts[word], 1)))

    best = {}
    for b in {band(v) for t in train for v in [0, *t]}:
        scores = []
        for mass in lm.KEPT_MASS:
            score = 0.0
            for t in train:
                for v, w in zip([0, *t], t):
                    if band(v) == b:
                        left = (pairs[v, w] - 1) / max(contexts[v] - 1, 1)
                        score += math.log(mass * unigram(seen[w] - 1, total - 1) + (1 - mass) * left)
            scores.append(score)
        best[b] = lm.KEPT_MASS[int(np.argmax(scores))]
    out = collections.Counter()
    for i, t in texts:
        base = score = 0.0
        for v, w in zip([0, *t], t):
            u = unigram(seen[w])
            base += math.log10(u)
            if contexts[v]:
                mass = best.get(band(v), 1.0)
                score += math.log10(mass * u + (1 - mass) * pairs[v, w] / contexts[v])
            else:
                score += math.log10(u)
        known = sum(seen[w] > 0 for w in t)
        out[i, held(i), len(t), known, total, round(base, 6), round(score, 6)] += 1
    return out


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    found = lm.score_documents(df, held_out()).collect()
    got = collections.Counter(
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
        for r in found
    )
    assert got == brute(rows)


def test_documents_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500)
    check(from_files(spark, "documents", 60))


def test_awkward_rows(spark):
    check(messy(spark))


def test_empty_table_and_nothing_to_learn(spark):
    assert lm.score_documents(empty(spark), held_out()).count() == 0
    row = lm.score_documents(messy(spark).limit(1), F.lit(True)).first()
    assert row.n_known == 0 and row.train_tokens == 0 and row.score == pytest.approx(row.base_score)


def test_states_keep_all_probability():
    """Arcs and failure arc of a state add up to one over known words and the unknown class."""
    seen = np.array([5, 3, 0])
    # (previous, word) as previous * 4 + word, in order; 3 is the start.
    keys = np.array([0 * 4 + 0, 0 * 4 + 1, 1 * 4 + 0, 3 * 4 + 0])
    met = np.array([3, 2, 3, 2])
    kept = np.full(lm._BANDS, 0.3)
    net = lm.build_automaton(seen, keys, met, kept, 8, 2, 2)
    one = np.array([1])
    for context in ([], [0], [1]):
        mass = 0.0
        for word in (0, 1, 2):
            text = np.array([*context, word])
            own = net.read(text, np.array([0]), one * len(text))[0]
            before = net.read(text[:-1], np.array([0]), one * len(context))[0] if context else 0.0
            mass += 10 ** (own - before)
        assert mass == pytest.approx(1.0)


def test_log_sums_are_those_of_each_token():
    turn = np.random.default_rng(3)
    single, double, band = turn.random(500) * 1e-9 + 1e-11, turn.random(500), turn.integers(0, lm._BANDS, 500)
    double[::3] = 0
    wanted = np.zeros((lm._BANDS, len(lm.KEPT_MASS)))
    for i, mass in enumerate(lm.KEPT_MASS):
        np.add.at(wanted[:, i], band, np.log(mass * single + (1 - mass) * double))
    assert lm._log_sums(single, double, band) == pytest.approx(wanted)
    assert not lm._log_sums(single[:0], double[:0], band[:0]).any()


def test_a_long_text_takes_few_steps(monkeypatch):
    net = lm.build_automaton(
        np.array([5, 3, 0]), np.array([0, 1, 4, 12]), np.array([3, 2, 3, 2]), np.full(lm._BANDS, 0.3), 8, 2, 2
    )
    looked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: looked.append(1) or search(*a, **k))
    text = np.tile([0, 1, 2, 0, 0], 400)
    found = net.read(text, np.array([0, 1990]), np.array([1990, 10]))
    assert len(looked) < 10
    once = [net.read(text, np.array([0]), np.array([k]))[0] for k in (5, 10, 15)]
    # From the second time on, each five words add the same.
    assert once[2] - once[1] == pytest.approx(once[1] - once[0])
    assert found == pytest.approx([once[0] + 397 * (once[1] - once[0]), once[1]])


def test_better_than_unigrams_on_held_out_text(spark):
    row = (
        lm.op4_language_model(spark, "/root/testdata/sf0.001").where("held_out")
        .agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    )
    assert row.s > row.b
