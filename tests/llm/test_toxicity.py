import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import empty, messy

pytest.importorskip("plumbline.llm")
from plumbline.llm import toxicity as tx  # noqa: E402


def plain_kernel(a, b):
    def features(word):
        codes = [tx._START, *tx._code_table()[[ord(c) for c in word]], tx._STOP]
        found = {}
        for i, j, k in itertools.combinations(range(len(codes)), 3):
            if k - i <= tx._SPAN:
                key = codes[i], codes[j], codes[k]
                found[key] = found.get(key, 0.0) + tx._DECAY ** (k - i - 2)
        return found

    def product(x, y):
        return sum(v * y.get(u, 0.0) for u, v in x.items())

    x, y = features(a), features(b)
    norm = np.sqrt(product(x, x) * product(y, y))
    return product(x, y) / norm if norm else 0.0


def test_kernel_by_definition():
    words = ["idiot", "idxiot", "aaaa", "a", "ab", "thehe", "loser", "closer", "ñandú", "x1y2"]
    found = tx.kernel(words, words)
    for (i, a), (j, b) in itertools.product(enumerate(words), enumerate(words)):
        assert found[i, j] == pytest.approx(plain_kernel(a, b), abs=1e-9)


def test_table_gives_the_value_of_the_landmarks():
    positive, negative = ["idiot", "moron", "stupid"], ["the", "and", "water", "closer", "mornings", "idea"]
    machine = tx.train(positive, [3, 2, 1], negative)
    probe = ["idiotic", "moral", "stupor", "wat"]
    values = machine.values(probe, tx._code_table())
    assert values[0] > values[3] and len(values) == 4
    assert (machine.values(positive, tx._code_table()) > 0).all()
    assert (machine.values(negative, tx._code_table()) < 0).all()


def test_units():
    assert "idiot" in tx.units("you i.d.i.o.t") and "idiot" in tx.units("you i d i o t")
    assert max(map(len, tx.units("x" * 1000))) <= tx._LONGEST
    assert tx.units("") == [] and tx.units(" .,") == []


def test_held_out_documents(spark):
    """Labelled documents the machine has not seen; a few dozen toxic ones to learn from."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = tx.op8_string_kernel_toxicity(spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean])
    assert wins > 0.7


def insults(spark):
    turn = np.random.default_rng(2)
    plain = ["water", "house", "morning", "people", "ground", "simple", "letter", "number", "season", "family", "closing"]
    rows = []
    for i in range(200):
        text = list(turn.choice(plain, 12))
        if i % 4 == 0:
            text[int(turn.integers(12))] = turn.choice(["idiot", "moron", "stupid"])
        rows.append((i, " ".join(text), i % 4 == 0))
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame(
        [(i, int(y)) for i, _, y in rows], "doc_id long, toxic int"
    )


def test_gaps_and_inserted_characters(spark):
    machine = tx.fit_machine(*insults(spark))
    probes = ["a water idxiot", "m.o.r.o.n people", "you s t u p i d", "stuupid house"]
    calm = ["water house", "the morning people", "number of letters", ""]
    scorer = tx.Scorer(machine)
    assert (machine.probability(scorer.worst(probes)) >= 0.7).all()
    assert (machine.probability(scorer.worst(calm)) < 0.5).all()


def test_texts_score_like_the_worst_of_their_words():
    table = np.random.default_rng(5).normal(size=tx._FEATURES)
    machine = tx.Machine(table, 0.1)
    texts = [
        "You  i d i o t, m.o.r.o.n\u00a0and_so on\x1fA\tB c D\ne f", "ΑΣ Σ Σ ΑΣ İ i̇ q", "", " .,_ ", "x y", "x y z", "x y\nz",
        "x y z.", "a" * 200 + ".b-" + "c" * 30, ("d." * 90 + " ") * 2, "é è ê ü 漢 字 !", "a  b  c", "a b c d" * 20,
    ]
    found = tx.Scorer(machine).worst(texts)
    for text, value in zip(texts, found):
        words = tx.units(text)
        assert value == (machine.values(words, tx._code_table()).max() if words else tx._NOTHING)


def test_repeated_words_are_split_once(monkeypatch):
    split = []
    for name in ("units", "stretch_units"):
        monkeypatch.setattr(tx, name, lambda text, old=getattr(tx, name): split.append(text) or old(text))
    scorer = tx.Scorer(tx.Machine(np.zeros(tx._FEATURES), 0.0))
    scorer.worst([f"the water of house {i % 7}" for i in range(500)])
    assert sum(map(len, split)) < 100


def test_awkward_rows(spark):
    docs, labels = insults(spark)
    machine = tx.fit_machine(docs, labels.unionAll(spark.createDataFrame([(None, 1), (1, None)], labels.schema)))
    rows = tx.score_toxicity(messy(spark), machine).collect()
    assert len(rows) == messy(spark).count() and all(0 <= r.score <= 1 for r in rows)
    assert tx.fit_machine(docs, labels.where("toxic = 0")) is None
    assert {r.score for r in tx.score_toxicity(messy(spark), None).collect()} == {0.0}


def test_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.fit_machine(empty(spark), labels) is None
    assert tx.score_toxicity(empty(spark), None).agg(F.count("*")).first()[0] == 0
