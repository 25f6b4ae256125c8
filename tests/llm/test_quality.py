import collections
import math
import re
import struct

import pytest
import xxhash

from helpers import empty, from_files, messy, words

pytest.importorskip("plumbline.llm")
from plumbline.llm import quality  # noqa: E402

import regex  # noqa: E402


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def grams(text, buckets):
    tokens = regex.findall(quality._TOKENS, (text or "").lower())
    hashes = [signed(xxhash.xxh64_intdigest(t.encode(), seed=42)) for t in tokens]
    pairs = []
    for a, b in zip(hashes, hashes[1:]):
        seed = 42
        for h in (a, b):
            seed = xxhash.xxh64_intdigest(struct.pack("<q", h), seed=seed)
        pairs.append(signed(seed) % buckets)
    return [h % buckets for h in hashes] + pairs


def brute(rows, trusted, buckets=64, threshold=quality.THRESHOLD):
    raw = collections.Counter(g for _, t in rows for g in grams(t, buckets))
    good = collections.Counter(g for i, t in rows if i in trusted for g in grams(t, buckets))
    t, r = sum(good.values()), sum(raw.values())
    ratio = [
        float(f"{round(math.log((good[b] + 1) / (t + buckets)) - math.log((raw[b] + 1) / (r + buckets)), 6):g}")
        if good else 0.0
        for b in range(buckets)
    ]
    out = collections.Counter()
    for i, text in rows:
        text = text or ""
        w = words(text, lower=False)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        counts = collections.Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if counts[x] > 1 for d in range(5)}
        lines = [line for line in text.split("\n") if words(line)]
        g = grams(text, buckets)
        score = sum(ratio[b] for b in g) / len(g) if g else 0.0
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        out[
            i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed,
            round(score, 9), not failed and score >= threshold,
        ] += 1
    return out


def check(df, labels):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    trusted = {r.doc_id for r in labels.collect() if r.doc_id is not None}
    ratios = quality.fit_quality(df, labels, buckets=64)
    got = collections.Counter(
        (r.doc_id, *r.quality[:6], round(r.quality.score, 9), r.quality.kept)
        for r in quality.judge(df, ratios).collect()
    )
    assert got == brute(rows, trusted)
    at_once = collections.Counter(
        (r.doc_id, *r.quality[:6], round(r.quality.score, 9), r.quality.kept)
        for r in quality.assess(df, labels, buckets=64).collect()
    )
    assert at_once == got


def test_documents(spark):
    check(from_files(spark, "documents"), quality.trusted_ids(from_files(spark, "labels")))


def test_awkward_rows(spark):
    check(messy(spark), spark.createDataFrame([(1,), (1,), (9,), (None,), (99,)], "doc_id long"))


def test_nothing_is_trusted(spark):
    none = spark.createDataFrame([], "doc_id long")
    check(messy(spark), none)
    kept = quality.judge(messy(spark), quality.fit_quality(messy(spark), none)).where("quality.kept")
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 9}


def test_empty_table(spark):
    ratios = quality.fit_quality(empty(spark), spark.createDataFrame([], "doc_id long"))
    assert quality.judge(empty(spark), ratios).count() == 0


def test_other_columns_stay(spark):
    judged = quality.judge(messy(spark), [0.0] * 4, name="verdict")
    assert judged.columns == [*messy(spark).columns, "verdict"]


def test_no_python_in_the_plan(spark):
    df = from_files(spark, "documents")
    plan = quality.judge(df, [0.0] * 4)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_good_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    judged = quality.op5_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in judged.where("n_words >= 20").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.02 * counts[1, True]
    assert counts.get((0, True), 0) <= 0.1 * counts[0, False]


def test_assessing_keeps_columns_and_uses_no_python(spark):
    df = messy(spark)
    none = spark.createDataFrame([], "doc_id long")
    assert quality.assess(df, none, name="verdict").columns == [*df.columns, "verdict"]
    narrow = quality.assess(from_files(spark, "documents"), none, columns=["lang"])
    assert narrow.columns == ["lang", "quality"]
    plan = narrow._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.assess(empty(spark), none).count() == 0
