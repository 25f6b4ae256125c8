import random
import time

import pytest
import sentencepiece

from helpers import empty, from_files, messy

pytest.importorskip("plumbline.llm")
from plumbline.llm import token_counts as tc  # noqa: E402


@pytest.fixture(scope="module")
def model():
    return tc.load_ranks()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tc.MODEL)


HARD = [
    "", "a", " ", "  a  b\nc\t▁é😀 ", "\n\n \n", "▁▁ x", "<s> </s> <unk> <0x41>", "      deep\n\n    x", "é" * 5,
    "漢字 kana", "nul\x00byte", "ends with spaces   ", "\r\n \x0b", "a▁b", "é ‍", "aaaaaaaaaaaaaaaaaaaaaaaaa",
]


def brute(word, ranks, single):
    """Merges the best pair of the whole list again and again."""
    parts = list(word)
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return sum(1 if len(p) > 1 or p in single else len(p.encode()) for p in parts)
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_hard_texts_equal_the_library(model, library):
    count = tc.counter(model)
    for text in HARD:
        assert count(text) == len(library.encode(text)), text


@pytest.mark.parametrize("seed", range(5))
def test_random_texts_equal_the_library(model, library, seed):
    turn = random.Random(seed)
    count = tc.counter(model)
    for alphabet in ("ab ", "the quick brown fox", "aeéß漢😀▁ \n\t", "0123456789.,-()"):
        for _ in range(60):
            text = "".join(turn.choices(alphabet, k=turn.randrange(1, 80)))
            assert count(text) == len(library.encode(text)), text


@pytest.mark.parametrize("seed", range(5))
def test_heap_equals_repeated_search(seed):
    turn = random.Random(seed)
    # Ranks that tie, and pieces that no merge makes.
    pieces = {"".join(turn.choices("abc", k=turn.randrange(2, 6))) for _ in range(30)}
    ranks = {piece: turn.randrange(12) for piece in sorted(pieces)}
    for _ in range(200):
        word = "".join(turn.choices("abcdé", k=turn.randrange(1, 40)))
        assert tc.merged_count(word, ranks, frozenset("abc")) == brute(word, ranks, frozenset("abc"))


def test_long_word_without_a_space(model, library):
    text = "".join(random.Random(1).choices("etaoinshrdlu", k=200_000))
    start = time.perf_counter()
    assert tc.counter(model)(text) == len(library.encode(text))
    assert time.perf_counter() - start < 60


def test_forgetting_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(tc, "_REMEMBERED", 20)
    count = tc.counter(model)
    text = "one two three four five six seven eight nine ten " * 5
    assert count(text) == len(library.encode(text))


def test_messy_rows(spark, model, library):
    rows = tc.count_tokens(messy(spark), model, limit=3).collect()
    given = messy(spark).collect()
    wanted = sorted(
        (str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in given
    )
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == wanted
    assert all(r.over_limit == (r.n_tokens > 3) for r in rows)
    assert tc.count_tokens(empty(spark), model).collect() == []


def test_all_documents_equal_the_library(spark, library):
    docs = from_files(spark, "documents").collect()
    wanted = {r.doc_id: len(ids) for r, ids in zip(docs, library.encode([r.text or "" for r in docs]))}
    rows = tc.op13_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == wanted
    assert {r.doc_id: r.n_bytes for r in rows} == {r.doc_id: len((r.text or "").encode()) for r in docs}
