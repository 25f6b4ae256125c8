import collections
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import empty, from_files, messy

pytest.importorskip("plumbline.llm")
from plumbline.llm import suffix_dedup as sd  # noqa: E402


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    counts = collections.Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for raw in raws:
        covered = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if counts[raw[p : p + length]] > 1:
                covered[p : p + length] = b"\1" * length
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        out.append((sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(df, length, gram):
    rows = df.select("doc_id", "text").collect()
    wanted = collections.Counter((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], length)))
    got = collections.Counter(
        (r.id, sum(s.stop - s.start for s in r.runs), len(r.runs), hashlib.sha256(r.kept).hexdigest())
        for r in sd.remove_repeats(df, length=length, gram=gram).collect()
    )
    assert got == wanted


@given(st.lists(st.binary(max_size=40).map(lambda b: b.replace(b"\x01", b"\x00")), unique=True, min_size=1), st.sampled_from([0, 8, 64]))
@settings(max_examples=150, deadline=None)
def test_order_is_that_of_bytes(strings, shallow):
    order = sd.deep_shallow_order(strings, shallow)
    assert [strings[i] for i in order] == sorted(strings)


@pytest.mark.parametrize("seed", [0, 1])
def test_order_of_long_common_prefixes(seed):
    turn = random.Random(seed)
    strings = list({bytes(turn.choices(b"ab", k=turn.randrange(6))) * turn.randrange(1, 60) for _ in range(60)})
    assert [strings[i] for i in sd.deep_shallow_order(strings)] == sorted(strings)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_overlapping_repeats(spark, seed):
    turn = random.Random(seed)
    base = ["".join(turn.choices("abé", k=60)) for _ in range(4)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(turn.randrange(6)):
            passage = turn.choice(base)
            parts.append(passage[turn.randrange(30) : turn.randrange(20, 60)] if turn.random() < 0.7 else "".join(turn.choices("ab", k=9)))
        rows.append((i, "".join(parts)))
    rows += [(500, "a" * 100), (501, "ab" * 50), (502, "x"), (502, "x"), (None, "q" * 50), (0, rows[1][1])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 20, 8)


def test_awkward_rows(spark):
    check(messy(spark), 30, 10)


def test_documents(spark):
    check(from_files(spark, "documents", 100), 200, 48)


def test_full_map_lets_everything_through(spark, monkeypatch):
    """With few bits all grams look shared; the result is the same."""
    rows = [(i, f"{i} some passage that is repeated in all of them {i * 7} and an end") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    original = sd._level

    def full(session, counted, bound=0):
        level = original(session, counted, bound)
        level.shared.value[:] = 255
        return sd._Level(session.sparkContext.broadcast(level.shared.value), level.frequent, level.bound)

    monkeypatch.setattr(sd, "_level", full)
    check(df, 24, 8)


@pytest.mark.parametrize("group", [1, 3, 10, 30])
def test_frequent_segments(spark, monkeypatch, group):
    """Segments in more texts than a group may hold: parts of their ranges, then whole strings."""
    monkeypatch.setattr(sd, "GROUP", group)
    turn = random.Random(group)
    passage = "".join(turn.choices("abcdefgh", k=90))
    rows = []
    for i in range(60):
        own = ["".join(turn.choices("abcdefgh", k=turn.randrange(40))) for _ in range(2)]
        cut = turn.randrange(30) if i % 3 else 0
        rows.append((i, own[0] + passage[cut : 90 - turn.randrange(30) * (i % 2)] + own[1]))
    rows += [(100 + i, passage * 2) for i in range(15)] + [(200, "a" * 300), (201, "ab" * 90), (201, "ab" * 90), (None, passage)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 24, 8)
    check(from_files(spark, "documents", 60), 200, 48)


def test_groups_are_bounded(spark, monkeypatch):
    """A passage of all texts, with other bytes on both sides each time, gives no large group."""
    monkeypatch.setattr(sd, "GROUP", 20)
    grouped, original = [], sd._grouped
    monkeypatch.setattr(sd, "_grouped", lambda session, contexts, length: grouped.append(contexts) or original(session, contexts, length))
    turn = random.Random(5)
    passage = "".join(turn.choices("abcdefgh", k=60))
    rows = [(i, "".join(turn.choices("ijklm", k=50)) + passage + "".join(turn.choices("ijklm", k=50))) for i in range(300)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 24, 8)
    assert len(grouped) == 2
    for contexts in grouped:
        rows = contexts.selectExpr("segment", "IF(frequent, 1, size(ids)) AS n").groupBy("segment").sum("n").toPandas()
        assert rows.empty or rows["sum(n)"].max() <= 20


@pytest.mark.parametrize("seed", range(6))
def test_repeats_of_contexts(seed):
    """Against every pair of contexts."""
    turn = random.Random(seed)
    for _ in range(200):
        size, length = turn.randrange(1, 14), turn.randrange(3, 14)
        some = lambda k: bytes(turn.choices(b"ab", weights=[6, 1], k=turn.randrange(k)))
        members = list({(some(9), b"g" + some(12)) for _ in range(size)})
        counts = [turn.choice([1, 1, 1, 2]) for _ in members]
        wanted = []
        for i, (left, right) in enumerate(members):
            run = (0, 0)
            for k, (other_left, other_right) in enumerate(members):
                a, b = sd._common(left, other_left), sd._common(right, other_right)
                if (i != k or counts[i] > 1) and a + b >= length:
                    run = max(run[0], a), max(run[1], b)
            wanted.append(run)
        assert sd.repeats(members, counts, length) == wanted


def test_empty_table(spark):
    assert sd.remove_repeats(empty(spark)).count() == 0


def test_copies_of_a_row_hold_their_runs_once(spark, monkeypatch):
    settled, settle = [], sd.settle
    monkeypatch.setattr(sd, "settle", lambda df, label: settled.append(settle(df, label)) or settled[-1])
    text = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(900))
    docs = spark.createDataFrame([(1, text)] * 40, "doc_id long, text string")
    rows = sd.remove_repeats(docs).collect()
    assert len(rows) == 40 and {bytes(r.kept) for r in rows} == {b""}
    (held,) = settled[-1].collect()
    assert len(held.runs) == len(set(held.runs))
