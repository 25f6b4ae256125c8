import collections
import random
import re

import pyarrow.parquet as pq
import pytest

from helpers import LOWER, empty, messy

pytest.importorskip("plumbline.llm")
from plumbline.llm import decontaminate as dc  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    phrases = collections.defaultdict(set)
    for name, text in items:
        w = words(text)
        for k in range(max(len(w) - window + 1, min(len(w), 1))):
            phrases[tuple(w[k : k + window])].add(name)
    out = collections.Counter()
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(w) - size + 1):
                names = phrases.get(tuple(w[k : k + size]))
                if names:
                    hit |= set(range(k, k + size))
                    found |= {str(n) for n in names if n is not None}
        out[i, len(w), len(hit), tuple(sorted(found))] += 1
    return out


def check(spark, docs, items):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in dc.contamination(df, bench).collect())
    assert got == brute(docs, items)


def made(seed, count=120):
    turn = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["The", "É", "x9"]
    items = [(k, " ".join(turn.choices(vocabulary, k=turn.choice([0, 1, 2, 5, 10, 11, 25])))) for k in range(25)]
    docs = []
    for i in range(count):
        parts = [turn.choice(vocabulary) for _ in range(turn.randrange(40))]
        for _ in range(turn.randrange(3)):
            passage = words(turn.choice(items)[1])
            at = turn.randrange(len(parts) + 1)
            parts[at:at] = passage[turn.randrange(3) :]
        docs.append((i, turn.choice([" ", ", ", "-"]).join(parts)))
    return docs, items


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    check(spark, *made(seed))


def test_in_small_batches_of_phrases(spark, monkeypatch):
    monkeypatch.setattr(dc, "PHRASES_AT_ONCE", 20)
    check(spark, *made(2, 60))


def test_no_task_holds_all_that_another_wrote(spark):
    # 10 MB of text written by one task: no row group, and so no page, has more than a few blocks.
    some = "concat_ws(' ', transform(sequence(1, 20000), k -> cast(pmod(hash(id, k), 90000) as string)))"
    docs = spark.range(0, 90, 1, 1).selectExpr("id as doc_id", f"{some} as text")
    index = dc.build_index(docs)
    sizes = []
    for path in index.table.inputFiles():
        footer = pq.ParquetFile(path.removeprefix("file://")).metadata
        sizes += [footer.row_group(k).total_byte_size for k in range(footer.num_row_groups)]
    assert sum(sizes) > 2 * max(sizes) and max(sizes) < 6 << 20
    assert index.documents().where("n_words = 20000").count() == 90


def test_awkward_rows(spark):
    docs = [(r.doc_id, r.text) for r in messy(spark).collect()]
    items = [(1, "quick brown fox jumps over the lazy dog and runs far"), (10, "two"), (9, None), (8, ""), (2, "..."), (None, "long long")]
    check(spark, docs, items)
    found = dc.contamination(messy(spark), spark.createDataFrame(items, "item_id long, text string"))
    assert found.where("doc_id = 11").count() == 2


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.contamination(empty(spark), items).count() == 0
    rows = dc.contamination(messy(spark), items.where("false")).collect()
    assert len(rows) == messy(spark).count() and not any(r.n_hit for r in rows)


def test_proximity(spark):
    docs = spark.createDataFrame(
        [(1, "red green blue"), (2, "red x green y blue"), (3, "green red blue"), (4, "red x x x green blue"), (5, "red"), (6, "green blue")],
        "doc_id long, text string",
    )
    phrase = dc.phrases_of(spark.createDataFrame([(7, "red green blue")], "item_id long, text string"))
    index = dc.build_index(docs)
    named = index.documents().select("block", "place", "id")

    def hits(slop):
        found = dc.search(index, phrase, slop).join(named, ["block", "place"]).collect()
        return {(r.id, r.start, r.stop) for r in found}

    assert hits(0) == {(1, 0, 3)}
    assert hits(2) == {(1, 0, 3), (2, 0, 5)}
    assert hits(3) == {(1, 0, 3), (2, 0, 5), (4, 0, 6)}
