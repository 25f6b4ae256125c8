import random

import numpy as np
import pytest

from helpers import empty, from_files, messy

pytest.importorskip("plumbline.llm")
from plumbline.llm import pieces as pc  # noqa: E402


@pytest.fixture(scope="module")
def model():
    return pc.load_model()


def brute(net, table, text):
    """Best segmentation by trying every piece at every place; the longest one wins ties."""
    if not text:
        return []
    marks = "".join("▁" if c == " " else "\0" if c == "▁" else c for c in " " + text)
    longest = max(map(len, table))
    best, back = [0.0] * (len(marks) + 1), [None] * (len(marks) + 1)
    for end in range(1, len(marks) + 1):
        best[end] = best[end - 1] + net.unknown
        for size in range(min(longest, end), 0, -1):
            piece = table.get(marks[end - size : end])
            if piece is not None and best[end - size] + net.scores[piece] > best[end]:
                best[end], back[end] = best[end - size] + net.scores[piece], piece
    ids, end = [], len(marks)
    while end:
        if back[end] is None:
            ids[:0] = [int(net.byte_ids[b]) for b in (" " + text)[end - 1].encode()]
            end -= 1
        else:
            ids.insert(0, back[end])
            end -= int(net.lengths[back[end]])
    return ids


def small(pieces, scores):
    bytes_ = [f"<0x{b:02X}>" for b in range(256)]
    matched = [True] * len(pieces) + [False] * 256
    net = pc.build_automaton(pieces + bytes_, scores + [-50.0] * 256, matched, list(range(len(pieces), len(pieces) + 256)))
    return net, {p: i for i, p in enumerate(pieces)}


HARD = ["", "a", " ", "  a  b\nc\t▁é😀 ", "\n\n \n", "▁▁ x", "<s> </s> <unk> <0x41>", "      deep\n\n    x", "é" * 5, "漢字 kana"]


def encoded(net, texts):
    ids, starts = pc.Encoder(net).encode(texts)
    return [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_over_small_models(seed):
    turn = random.Random(seed)
    pieces = list({turn.choice(["", "▁"]) + "".join(turn.choices("abc", k=turn.randrange(1, 5))) for _ in range(25)} | {"▁"})
    # A piece that goes beyond a word's end makes whole texts the unit.
    pieces += ["a▁b"] if seed % 2 else []
    net, table = small(pieces, [-turn.randrange(1, 8) * 1.0 for _ in pieces])
    assert net.by_words == (not seed % 2)
    texts = ["".join(turn.choices("abcd ", k=turn.randrange(30))) for _ in range(60)]
    assert encoded(net, texts) == [brute(net, table, t) for t in texts]


def test_given_model(model, spark):
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=pc.MODEL)
    table = {
        reader.id_to_piece(i): i
        for i in range(reader.get_piece_size())
        if not (reader.is_byte(i) or reader.is_control(i) or reader.is_unknown(i))
    }
    texts = HARD + [r.text[:1500] for r in from_files(spark, "documents", 20).collect()]
    found = encoded(model, texts)
    assert found == [brute(model, table, t) for t in texts]
    for ids, text in zip(found, texts):
        assert pc.decode_ids(model.spelled, ids) == text
        if "▁" not in text:
            assert reader.decode(ids) == text


def test_forgetting_changes_nothing(model, monkeypatch):
    texts = ["some words that go on", "other words", "some words again"]
    wanted = encoded(model, texts)
    monkeypatch.setattr(pc, "_REMEMBERED", 0)
    encoder = pc.Encoder(model)
    assert [encoder.encode([t])[0].tolist() for t in texts] == wanted


def test_round_trip_of_all_documents(spark, model):
    docs = from_files(spark, "documents")
    back = pc.decode(pc.encode(docs, model), model)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in back.collect()} == texts


def test_awkward_rows(spark, model):
    rows = pc.decode(pc.encode(messy(spark), model), model).collect()
    wanted = sorted((str(r.doc_id), r.text or "") for r in messy(spark).collect())
    assert sorted((str(r.doc_id), r.text) for r in rows) == wanted


def test_empty_table(spark, model):
    assert pc.encode(empty(spark), model).count() == 0


def test_ids_outside_the_model_are_left_out(model):
    assert pc.decode_ids(model.spelled, [-1, 10**6]) == ""


def test_long_word(model):
    ids, _ = pc.Encoder(model).encode(["ab" * 20_000])
    assert pc.decode_ids(model.spelled, ids.tolist()) == "ab" * 20_000
    assert isinstance(ids, np.ndarray)


def merged_by_hand(scores, text):
    """Best score first, the leftmost of equal ones."""
    parts = list("▁" + text.replace(" ", "▁")) if text else []
    while steps := [(-scores[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]:
        _, k = min(steps)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


@pytest.mark.parametrize("seed", range(6))
def test_merges_of_small_models(seed):
    turn = random.Random(seed)
    scores = {c: -1000.0 for c in "▁abc"}
    for rank in range(25):
        # Equal scores, pieces no text is merged to, and pieces that go beyond a word's end.
        made = "".join(turn.choices(list(scores), k=2))
        if made not in scores and (seed % 2 or "▁" not in made.lstrip("▁")):
            scores[made] = -float(rank // 2)
    pieces = list(scores)
    net, table = small(pieces, [scores[p] for p in pieces])
    net = pc.replace(net, merges=pc.find_merges(pieces, [scores[p] for p in pieces], [True] * len(pieces)))
    texts = ["".join(turn.choices("abc ", k=turn.randrange(30))) for _ in range(200)]
    ids, starts = pc.MergeEncoder(net).encode(texts)
    found = [[pieces[i] for i in ids[a:b]] for a, b in zip(starts[:-1], starts[1:])]
    assert found == [merged_by_hand(scores, t) for t in texts]


def test_the_models_own_encoding_of_whole_documents(model, spark):
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=pc.MODEL)
    docs = from_files(spark, "documents")
    found = {r.doc_id: r.pieces for r in pc.encode(docs, model).collect()}
    assert found == {r.doc_id: reader.encode(r.text) for r in docs.collect()}
    texts = [t for t in HARD if "▁" not in t] + ["understanding", "the", " " * 37 + "x", "e\0f"]
    ids, starts = pc.MergeEncoder(model).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [reader.encode(t) for t in texts]


def test_query_returns_a_digest_of_the_round_trip(spark):
    from hashlib import sha256

    rows = pc.op9_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in from_files(spark, "documents").collect()}
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {
        i: sha256(t.encode()).hexdigest() for i, t in texts.items()
    }


def test_round_trip_equals_decoding(spark, model):
    from hashlib import sha256

    rows = pc.round_trip(messy(spark), model).collect()
    assert sorted((str(r.doc_id), r.decoded_sha256) for r in rows) == sorted(
        (str(r.doc_id), sha256((r.text or "").encode()).hexdigest()) for r in messy(spark).collect()
    )
    assert pc.round_trip(empty(spark), model).count() == 0


def test_spelling_many_lists_at_once(model):
    spelled = np.frombuffer(b"".join(model.spelled), np.uint8)
    offsets = np.cumsum([0, *map(len, model.spelled)])
    ids, starts = pc.MergeEncoder(model).encode(HARD)
    found = pc.spell_all(spelled, offsets, ids, starts)
    assert [b.decode().removeprefix(" ") for b in found] == HARD
