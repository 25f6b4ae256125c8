import itertools
import random

import numpy as np
import pytest

from helpers import empty, from_files, messy, words

pytest.importorskip("plumbline.llm")
from plumbline.llm import ngram_join  # noqa: E402
from plumbline.llm.components import components  # noqa: E402


def sets_of(rows, n):
    found = {}
    for i, text in rows:
        w = words(text)
        runs = [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] or ([tuple(w)] if w else [])
        found.setdefault(i, []).append(frozenset(runs))
    return found


def brute(rows, n, percent):
    sets = sets_of([r for r in rows if r[0] is not None], n)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        pairs = itertools.product(sets[a], sets[b])
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x, y in pairs):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {i: top(i) for i in sets}


def check(df, n, percent):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    found = ngram_join.jaccard_join(df, n=n, percent=percent).members.collect()
    assert len(found) == len(rows)
    wanted = brute(rows, n, percent)
    sizes = sets_of(rows, n)
    for row in found:
        assert row.component == wanted.get(row.id)
        assert row.n_shingles in {len(s) for s in sizes[row.id]}


def test_awkward_rows(spark):
    check(messy(spark), 3, 90)
    check(messy(spark), 5, 80)


def test_an_id_with_several_texts_joins_their_classes(spark):
    turn = random.Random(2)
    texts = [" ".join(turn.choices("abcdefgh", k=40)) for _ in range(5)]
    rows = [(3, texts[0]), (5, texts[0]), (5, texts[1]), (7, texts[1]), (5, ""), (9, None), (8, "")]
    rows += [(20, texts[2]), (11, texts[2]), (20, texts[3]), (30, texts[3]), (30, texts[4]), (4, texts[4] + " x")]
    rows += [(None, texts[0]), (None, ""), (None, texts[4])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)


def test_large_ids_beside_null_ids(spark):
    base = " ".join(f"w{k}" for k in range(60))
    far = 1 << 60
    rows = [(far + 1, base), (far + 3, base + " x"), (None, "something else"), (None, None), (far + 5, base + " y")]
    check(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 3, 90)


def test_empty_table(spark):
    assert ngram_join.jaccard_join(empty(spark)).members.count() == 0


def test_many_near_copies(spark, monkeypatch):
    """Edits around one base, in more copies than a bucket holds before it gets a pivot."""
    monkeypatch.setattr(ngram_join, "_LARGE_BUCKET", 3)
    turn = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(turn.randrange(5)):
            copy[turn.randrange(80)] = turn.choice(["x", "y", f"z{i}"])
        rows.append((i, " ".join(copy)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)


def test_frequent_tokens_only_steer(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_TOKENS", 4)
    check(from_files(spark, "documents"), 3, 90)


def test_prefix_size_by_definition():
    for percent, size in itertools.product((50, 80, 90, 100), range(1, 60)):
        overlap = int(np.ceil(percent * size / 100))
        assert ngram_join._prefix_size(size, percent) == size - overlap + 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 120)] + [(7, 7), (None, 3)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 120)}


def links_by_hand(rows, n, percent):
    """Pairs of the smallest ids of equal sets."""
    owners = {}
    for i, sets in sets_of(rows, n).items():
        for tokens in sets:
            if tokens:
                owners[tokens] = min(i, owners.get(tokens, i))
    pairs = itertools.combinations(owners, 2)
    return {
        (min(owners[x], owners[y]), max(owners[x], owners[y]))
        for x, y in pairs
        if owners[x] != owners[y] and 100 * len(x & y) >= percent * len(x | y)
    }


@pytest.mark.parametrize("block", [7, 256])
def test_links_are_whole(spark, monkeypatch, block):
    """All pairs of near copies, and not only those that connect them, in few or many blocks."""
    monkeypatch.setattr(ngram_join, "_BLOCK", block)
    monkeypatch.setattr(ngram_join, "_COLUMNS", 50)
    turn = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = [(200, " ".join(base[:40])), (201, " ".join(base[:39])), (202, ""), (203, None)]
    for i in range(90):
        copy = list(base)
        for _ in range(turn.randrange(4)):
            copy[turn.randrange(200)] = turn.choice(["x", "y", f"z{i}"])
        rows += [(i, " ".join(copy))] * turn.choice([1, 1, 2])
    found = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    links = [(r.a, r.b) for r in found.links.collect()]
    wanted = links_by_hand(rows, 3, 90)
    assert len(links) == len(set(links)) and set(links) == wanted and len(links) > 200
    component = brute(rows, 3, 90)
    counts = {}
    for a, _ in wanted:
        counts[component[a]] = counts.get(component[a], 0) + 1
    assert {r.component: r.n_links for r in found.counts.collect()} == counts


def test_query_counts_the_links_of_each_component(spark):
    rows = [(r.doc_id, r.text) for r in from_files(spark, "documents").collect()]
    component, counts = brute(rows, 3, 90), {}
    for a, _ in links_by_hand(rows, 3, 90):
        counts[component[a]] = counts.get(component[a], 0) + 1
    found = ngram_join.op1_ngram_jaccard_join(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.component_id, r.n_links) for r in found} == {
        i: (c, counts.get(c, 0)) for i, c in component.items()
    }


def test_only_documents_that_meet_others_have_prefixes_under_all_orders(spark, monkeypatch):
    asked, prefixes = [], ngram_join._prefixes

    def counted(n, percent, frequent, orders, filters):
        asked.append((list(orders), len(filters)))
        return prefixes(n, percent, frequent, orders, filters)

    monkeypatch.setattr(ngram_join, "_prefixes", counted)
    base = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(30)]
    rows = [(i, text) for i, text in enumerate(base)] + [(40, base[3] + " y"), (41, base[5]), (42, base[5])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    # The first order for all, alone or copied; the others for what the first lets through.
    assert asked == [([0], 1), ([0], 1), ([1, 2], 2), ([1, 2], 2)]


def test_filters_let_their_rows_through():
    import pyarrow as pa

    ids = np.arange(0, 4000, 7)
    bits = np.zeros(ngram_join._FILTER_BITS // 8, np.uint8)
    place = ngram_join._place_of(ids[::3])
    np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
    batch = pa.RecordBatch.from_arrays([pa.array(ids)], ["id"])
    inside, outside = (
        [i for part in ngram_join._let_through([batch], bits, wanted) for i in part.column(0).to_pylist()]
        for wanted in (True, False)
    )
    assert set(ids[::3]) <= set(inside) and sorted(inside + outside) == list(ids)
