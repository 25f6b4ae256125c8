import collections
import hashlib
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import empty, from_files, messy

pytest.importorskip("plumbline.llm")
from plumbline.llm import pii  # noqa: E402

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return [int(c) for c in text if c in "0123456789"]


def passes(number):
    total = 0
    for k, digit in enumerate(reversed(number)):
        digit *= 2 if k % 2 else 1
        total += digit // 10 + digit % 10
    return total % 10 == 0


def brute(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and passes(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found)


@given(st.text("a@.-+ 0123456789()x%é", max_size=60))
@settings(max_examples=600, deadline=None)
def test_rules_by_their_patterns(text):
    assert pii.rule_spans(text) == brute(text)


def test_documents(spark):
    df = from_files(spark, "documents")
    texts = {r.doc_id: r.text for r in df.collect()}
    for row in pii.op7_personal_data(spark, "/root/testdata/sf0.001").collect():
        base = brute(texts[row.doc_id])
        counts = collections.Counter(pii.KINDS[k] for _, k, _ in base)
        assert [row[f"n_{kind}"] for kind in pii.KINDS] == [counts[kind] for kind in pii.KINDS]
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(row.spans.split(","))


def test_awkward_rows(spark):
    df = messy(spark)
    rows = pii.find_personal_data(df, pii.fit_field(df)).collect()
    assert len(rows) == df.count()
    assert {r.doc_id for r in rows if r.base} == {14}
    clean = pii.redact(df, None)
    assert clean.columns == df.columns
    by_id = {r.doc_id: r.text for r in clean.collect()}
    assert by_id[7] is None and by_id[6] == "" and by_id[14] == "mail [EMAIL] or [PHONE] from [IP] with [CARD]."


def test_empty_table(spark):
    assert pii.fit_field(empty(spark)) is None
    assert pii.find_personal_data(empty(spark), None).count() == 0


@pytest.fixture(scope="module")
def weights():
    turn = np.random.default_rng(5)

    def number(k):
        return "".join(str(d) for d in turn.integers(1, 10, k))

    samples = []
    for _ in range(120):
        card = next(c for c in iter(lambda: "4" + number(15), "") if passes(digits(c)))
        for span in (
            f"{'abcdefgh'[turn.integers(8)]}x.{number(2)}@mail{number(1)}.example.com",
            ".".join(str(x) for x in turn.integers(1, 255, 4)),
            card,
            f"+1 ({number(3)}) 555-{number(4)}",
        ):
            text = f"some words {span} and more"
            samples.append((text, pii.rule_spans(text)))
    return pii.train(samples)


def test_other_notations_are_found(weights):
    for text, kind, span in (
        ("write to ann.lee at mail2 dot example dot com today", "email", "ann.lee at mail2 dot example dot com"),
        ("write to ann.lee [at] mail2 [dot] example [dot] com", "email", "ann.lee [at] mail2 [dot] example [dot] com"),
        ("call (459) 555-7405 now", "phone", "(459) 555-7405"),
        ("call 459-555-7405 now", "phone", "459-555-7405"),
    ):
        _, spans = pii.all_spans(text, weights)
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [(kind, span)]


def test_what_looks_alike_is_left(weights):
    for text in ("on 2024-01-02 at 12:30:45, see", "version 3.11.902 of it", "we meet at noon dot", "pages 12-19, 1200-1300"):
        assert pii.all_spans(text, weights)[1] == []


def test_base_spans_stay(weights):
    text = "x 4111 1111 1111 1111, 10.0.0.1 or +1 (555) 123-4567 a@b.co"
    base, every = pii.all_spans(text, weights)
    assert set(base) <= set(every) and len(base) == 4


def test_best_segmentation_by_enumeration(weights):
    text = "+1 (459) 555-7405 10.1.2.3"
    net = pii.lattice(text, 0, len(text))
    scores = (net.features @ weights.T - pii._MARGIN).max(axis=1)

    def best(at):
        if at >= len(net.bounds) - 1:
            return 0.0
        options = [best(at + 1)]
        options += [scores[k] + best(j) for k, (i, j) in enumerate(net.spans) if i == at]
        return max(options)

    where = {(net.bounds[i], net.bounds[j]): scores[k] for k, (i, j) in enumerate(net.spans)}
    found = sum(where[a, b] for a, _, b in pii.decode(net, weights))
    assert found == pytest.approx(best(0))


def test_probabilities_by_enumeration():
    text = "12 345 6789"
    net = pii.lattice(text, 0, len(text))
    scores = np.random.default_rng(0).normal(size=(len(net.spans), len(pii.KINDS)))
    totals = np.zeros_like(scores)

    def walk(at, chosen, total):
        if at == len(net.bounds) - 1:
            paths.append((chosen, total))
            return
        walk(at + 1, chosen, total)
        for k, (i, j) in enumerate(net.spans):
            if i == at:
                for kind in range(len(pii.KINDS)):
                    walk(j, [*chosen, (k, kind)], total + scores[k, kind])

    paths = []
    walk(0, [], 0.0)
    z = sum(np.exp(total) for _, total in paths)
    for chosen, total in paths:
        for k, kind in chosen:
            totals[k, kind] += np.exp(total) / z
    assert np.allclose(pii._expected(net, scores), totals)


def test_long_texts_take_no_long(weights):
    for text in ("1" * 50_000, "1." * 20_000, "@" * 50_000, "a@" * 30_000, "+1" * 30_000, "at " * 20_000, "1 " * 4_000):
        start = time.time()
        pii.all_spans(text, weights)
        assert time.time() - start < 20


def test_plain_spelled_addresses_have_a_feature():
    plain = pii._PATTERNS[2]
    assert plain.fullmatch("ann at mail dot example dot com") and not plain.fullmatch("ann at noon")


def test_long_spelled_addresses_are_candidates():
    text = "ann.lee [at] mail2 [dot] example [dot] co [dot] uk"
    net = pii.lattice(text, 0, len(text))
    assert (0, len(net.bounds) - 1) in net.spans
