import datetime as dt
import os
import threading

import pytest
from pyspark.sql import functions as F

from plumbline.operators.retrieve import text_topk
from plumbline.sources import versions
from plumbline.sources.history import find_run, latest_runs, read_history, save_run, save_runs
from plumbline.sources.report_index import find_report, read_index, upsert_reports
from plumbline.sources.versions import BUCKET, Conflict, VersionedTable

MOMENT = dt.datetime(2024, 5, 6, 7, 8, 9)
METRICS = "total_rows long, missing_pct double, duplicate_pct double, outlier_pct double, trust_score double"
RESULTS = (
    f"run_key string, filename string, created_at timestamp, before struct<{METRICS}>, was_cleaned boolean, "
    f"after struct<{METRICS}>, confidence_level string"
)


def results(spark, *keys, score=80.0):
    rows = [
        (k, f"{k}.csv", MOMENT + dt.timedelta(seconds=i), (1, 0.0, 0.0, 0.0, score), False, (1, 0.0, 0.0, 0.0, score), "High")
        for i, k in enumerate(keys)
    ]
    return spark.createDataFrame(rows, RESULTS)


def test_interleaved_saves_get_different_ids(spark, tmp_path, monkeypatch):
    """A second writer saves between the first one's look and its claim."""
    path = str(tmp_path / "history")
    save_run(results(spark, "first"), path, "first")
    publish, between = VersionedTable.publish, []

    def slow(self, base, parts, facts):
        if not between:
            between.append(True)
            assert save_run(results(spark, "fast"), path, "fast") == 2
        return publish(self, base, parts, facts)

    monkeypatch.setattr(VersionedTable, "publish", slow)
    assert save_run(results(spark, "slow"), path, "slow") == 3
    rows = {row.filename: row.id for row in read_history(spark, path).collect()}
    assert rows == {"first.csv": 1, "fast.csv": 2, "slow.csv": 3}


def test_many_writers_at_once(spark, tmp_path):
    path, found = str(tmp_path / "history"), {}

    def save(name):
        found[name] = save_run(results(spark, name), path, name)

    threads = [threading.Thread(target=save, args=(f"w{i}",)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(found.values()) == [1, 2, 3, 4, 5, 6]
    assert {row.filename[:-4]: row.id for row in read_history(spark, path).collect()} == found


def test_batches_and_repeated_keys(spark, tmp_path, monkeypatch):
    from plumbline.sources import history

    monkeypatch.setattr(history, "RUNS_PER_BUCKET", 4)
    path = str(tmp_path / "history")
    ids = save_runs(results(spark, *[f"k{i}" for i in range(10)]), path)
    assert ids == {f"k{i}": i + 1 for i in range(10)}
    again = save_runs(results(spark, "k7", "new", score=50.0), path)
    assert again == {"k7": 8, "new": 11}
    rows = {row.id: row.before_trust_score for row in read_history(spark, path).collect()}
    assert len(rows) == 11 and rows[8] == rows[11] == 50.0 and rows[7] == 80.0
    assert find_run(spark, path, 8).first().filename == "k7.csv"
    assert find_run(spark, path, 12).count() == find_run(spark, path, 500).count() == 0
    # Of three files only one is opened.
    assert len(find_run(spark, path, 2).inputFiles()) == 1 and len(read_history(spark, path).inputFiles()) == 3
    assert latest_runs(read_history(spark, path), 3).count() == 3
    with pytest.raises(ValueError):
        save_runs(results(spark, "a", "a"), path)
    assert save_runs(results(spark), path) == {}


def test_publishing_never_replaces(spark, tmp_path):
    files = versions._Files(spark)
    target = str(tmp_path / "v" / "1.json")
    assert files.create(target, "one") and not files.create(target, "two")
    assert files.read(target) == "one" and os.listdir(tmp_path / "v") == ["1.json"]
    assert not files.create(f"file://{target}", "three")


def test_endless_conflicts_are_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "_TRIES", 3)
    monkeypatch.setattr(versions, "_PAUSE_SECONDS", 0)
    monkeypatch.setattr(VersionedTable, "publish", lambda *_: False)
    table = VersionedTable(spark, str(tmp_path / "t"), "a int")
    with pytest.raises(Conflict):
        table.change(lambda _: ({}, {}, None))


INDEX = "doc_id string, run_id int, filename string, report_path string, text string, version long"


def entry(doc, version, text):
    return doc, 1, "f.csv", None, text, version


def test_upserts_rewrite_touched_buckets_only(spark, frame, tmp_path):
    path = str(tmp_path / "index")
    first = frame(INDEX, *[entry(f"d{i}", 1, f"text {i}") for i in range(200)])
    assert upsert_reports(first, path, buckets=16) == 16
    table = VersionedTable(spark, path, INDEX)
    before = table.latest()
    # Several changes of one document, and a new one.
    changes = frame(INDEX, entry("d5", 2, "old"), entry("d5", 4, "newest"), entry("d5", 3, "mid"), entry("n", 1, "new"), entry(None, 9, "x"))
    assert upsert_reports(changes, path) == 2
    after = table.latest()
    assert sum(before.parts[b] != after.parts[b] for b in before.parts) == 2
    rows = {row.doc_id: row.text for row in read_index(spark, path).collect()}
    assert len(rows) == read_index(spark, path).count() == 201
    assert rows["d5"] == "newest" and rows["n"] == "new" and rows["d6"] == "text 6"
    # The version read before is still whole.
    assert table.rows(before).where("doc_id = 'd5'").first().text == "text 5"
    assert find_report(spark, path, "d5").first().text == "newest" and find_report(spark, path, "none").count() == 0
    assert len(find_report(spark, path, "d5").inputFiles()) < len(read_index(spark, path).inputFiles())
    # A later session finds the documents by their words.
    asked = frame("question_id int, question string, run_id int, filename string", (1, "newest", None, None))
    assert text_topk(read_index(spark, path), asked, 1).first().doc_id == "d5"


def test_upserts_at_once(spark, frame, tmp_path):
    path = str(tmp_path / "index")
    upsert_reports(frame(INDEX, entry("a", 1, "a")), path, buckets=2)
    writers = [
        threading.Thread(target=upsert_reports, args=(frame(INDEX, entry("a", i, f"a{i}"), entry(f"w{i}", 1, "w")), path))
        for i in range(2, 6)
    ]
    [w.start() for w in writers]
    [w.join() for w in writers]
    rows = {row.doc_id: row.text for row in read_index(spark, path).collect()}
    # A later save replaces, whichever it was; nothing of the others is lost.
    assert set(rows) == {"a", "w2", "w3", "w4", "w5"} and rows["a"] in {"a2", "a3", "a4", "a5"}


def test_index_edges(spark, frame, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError):
        read_index(spark, path)
    assert upsert_reports(frame(INDEX, entry(None, 1, "x")), path) == 0
    upsert_reports(frame(INDEX, entry("a", 1, None), entry("", 1, "long " * 100_000)), path)
    assert {(r.doc_id, r.text and len(r.text)) for r in read_index(spark, path).collect()} == {("a", None), ("", 500_000)}
    with pytest.raises(ValueError):
        upsert_reports(frame("doc_id string, version long", ("a", 1)), path)
