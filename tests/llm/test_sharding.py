import random
import zlib

import pytest

from helpers import empty, from_files, messy

pytest.importorskip("plumbline.llm")
from plumbline.llm import sharding  # noqa: E402


def check(df, shards, tolerance=sharding.TOLERANCE):
    rows = sharding.shard(df, shards, tolerance=tolerance).collect()
    assert len(rows) == df.count()
    sizes = {}
    for row in rows:
        assert row["size"] == len((row.text or "").encode()) + 1
        assert 0 <= row.shard < shards
        sizes.setdefault(row.shard, []).append((row.slot, row["size"], row.text))
    for held in sizes.values():
        assert sorted(slot for slot, _, _ in held) == list(range(len(held)))
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for held in sizes.values():
        bytes_ = sum(size for _, size, _ in held)
        assert abs(bytes_ - total / shards) <= largest + 2 * tolerance * total / shards + 1
    return rows


def test_documents(spark):
    rows = check(from_files(spark, "documents"), 16)
    homes = {}
    for row in rows:
        homes.setdefault(row.text, set()).add(row.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 15


def test_awkward_rows(spark):
    rows = check(messy(spark), 4)
    # The columns of the result replace those of the same names, all others stay.
    assert set(rows[0].asDict()) == set(messy(spark).columns)
    assert {r.n for r in rows} == {6}


def test_one_text_is_most_of_the_table(spark):
    rows = [(i, "same text") for i in range(900)] + [(1000 + i, f"other {i}") for i in range(100)]
    random.Random(1).shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"), 8)


def test_all_rows_equal(spark):
    df = spark.createDataFrame([(1, "x")] * 50, "doc_id long, text string")
    check(df, 4)


def test_most_rows_equal_in_text_and_id(spark):
    rows = [(None, None)] * 400 + [(i, f"text {i}") for i in range(50)] + [(7, "a")] * 300
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = check(df, 4)
    assert set(found[0].asDict()) == {"doc_id", "text", "size", "shard", "slot"}


def test_empty_table(spark):
    assert sharding.shard(empty(spark), 16).count() == 0


def test_query_columns(spark):
    rows = sharding.op3_histogram_sort(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in from_files(spark, "documents").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
