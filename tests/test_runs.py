import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from checks.tables import dirty
from conftest import SMALLEST
from plumbline import run_quality
from plumbline.operators.reports import (
    build_report,
    index_reports,
    report_metadata,
    upsert_index,
)
from plumbline.operators.views import (
    cleaning_actions,
    cleaning_summary,
    health_grade,
    metric_trend,
    rows_removed,
    run_improvement,
    score_band,
)
from plumbline.plans.quality_run import needs_cleaning
from plumbline.sources.history import latest_runs, read_history, run_by_id, save_run, shown
from plumbline.sources.readers import read_csv, read_reports, read_table, report_names, table_format
from plumbline.sources.writers import download_name, export_name, export_table, result_json
from plumbline.streaming.ingest import ingest, landing_stream

MOMENT = dt.datetime(2024, 5, 6, 7, 8, 9)


@pytest.fixture(scope="module")
def cleaned_run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    run = run_quality(
        dirty(spark, SMALLEST),
        "my orders.csv",
        "row_id",
        scorer="formula",
        history=f"{folder}/history",
        reports=f"{folder}/reports",
        exports=f"{folder}/exports",
        created_at=MOMENT,
    )
    return run, folder


def test_threshold_is_strict():
    assert not needs_cleaning(95.0)
    assert needs_cleaning(94.99)


def test_cleaned_run(spark, cleaned_run):
    run, folder = cleaned_run
    row = run.result.first()
    assert row.was_cleaned and row.run_id == 1 and row.status == "SUCCESS"
    assert row.before.trust_score < row.after.trust_score
    assert row.download_name == "my orders_cleaned.csv"
    assert run.export_path.endswith("cleaned_1.csv")
    back = read_table(spark, run.export_path)
    assert back.count() == 1500 and "row_id" not in back.columns
    decoded = json.loads(result_json(run.result).first().json)
    assert decoded["cleaning_report"]["duplicates_removed"] == 75


def test_report_and_metadata(spark, cleaned_run):
    run, folder = cleaned_run
    (stored,) = read_reports(spark, f"{folder}/reports").collect()
    assert stored.doc_id == "run_1_my_orders"
    assert stored.text == run.result.first().report
    lines = stored.text.split("\n")
    assert "Run ID: 1" in lines and "Created At: 2024-05-06 07:08:09" in lines
    assert "- Removed 75 duplicate rows." in lines
    (found,) = report_metadata(read_reports(spark, f"{folder}/reports")).collect()
    assert (found.run_id, found.filename) == (1, "my orders.csv")


def test_views_of_a_run(cleaned_run):
    run, _ = cleaned_run
    summary = cleaning_summary(run.result).collect()
    assert [row.metric for row in summary] == ["null_col_ratio", "missing_pct", "duplicate_pct", "outlier_pct"]
    result = cleaning_actions(run.result).select("actions", rows_removed().alias("gone")).first()
    assert result.actions[0] == "Missing values fixed: 3,843"
    assert result.gone == 75


def test_run_without_cleaning(spark, frame, tmp_path):
    df = frame("v int, t string", *[(i, "NA" if i == 0 else None if i == 1 else "x") for i in range(100)])
    run = run_quality(df, "fine.csv", scorer="formula", history=str(tmp_path / "h"), threshold=50.0, created_at=MOMENT)
    row = run.result.first()
    assert not run.was_cleaned and run.export_path is None
    assert row.before.missing_count == 2
    # Markers are not counted where nothing was cleaned.
    assert row.cleaning_report.missing_before == row.cleaning_report.missing_after == 1
    assert "- Cleaning pipeline completed without major corrections." in row.report


def test_missing_cleaning_report(cleaned_run):
    run, _ = cleaned_run
    kind = run.result.schema["cleaning_report"].dataType
    bare = run.result.withColumn("cleaning_report", F.lit(None).cast(kind))
    text = build_report(bare).first().report
    assert "- No structured cleaning report was available." in text
    assert "Structured Cleaning Details" not in text
    fallback = cleaning_actions(bare).select("actions", rows_removed().alias("gone")).first()
    assert fallback.actions == [
        "Missing values fixed: 2,264", "Duplicate rows removed: 75", "Outliers handled: 11",
    ]
    assert fallback.gone == 75


def test_empty_table(frame):
    with pytest.raises(ValueError):
        run_quality(frame("v int"), "none.csv", scorer="formula")


def test_history(spark, cleaned_run, tmp_path):
    run, _ = cleaned_run
    path = str(tmp_path / "history")
    assert read_history(spark, path).count() == 0
    ids = [save_run(run.result, path, key) for key in ("a", "b", "a", "c")]
    assert ids == [1, 2, 1, 3]
    history = read_history(spark, path)
    assert [row.id for row in latest_runs(history).collect()] == [3, 2, 1]
    assert [row.id for row in latest_runs(history, 2).collect()] == [3, 2]
    assert run_by_id(history, 2).count() == 1 and run_by_id(history, 9).count() == 0
    row = shown(run_by_id(history, 1)).first()
    assert row.upload_time == "2024-05-06 07:08:09" and row.was_cleaned is True
    improved = run_improvement(history).first()
    assert improved.improvement == 11.1 and improved.above_threshold is False


def test_grades_bands_and_trends(frame):
    rows = frame("s double", 92.0, 91.99, 80.0, 68.0, 55.0, 40.0, 39.0)
    assert [r[0] for r in rows.select(health_grade(F.col("s"))).collect()] == [
        "A+", "A", "A", "B", "C", "D", "F",
    ]
    rows = frame("s double", 75.0, 50.0, 49.9, None).select(score_band(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["good", "fair", "poor", None]
    rows = frame("a double, b double", (10.0, 9.4), (1.0, 1.5), (1.0, 1.6), (None, 1.0))
    got = [r[0] for r in rows.select(metric_trend(F.col("a"), F.col("b"))).collect()]
    assert [r and tuple(r) for r in got] == [("down", "−0.6%"), ("flat", "±0%"), ("up", "+0.6%"), None]


def test_upsert_keeps_one_row_per_document(frame):
    schema = "doc_id string, version int, text string"
    index = frame(schema, ("a", 1, "old"), ("b", 1, "kept"))
    changes = frame(schema, ("a", 2, "new"), ("c", 2, "added"))
    again = frame(schema, ("a", 3, "newest"))
    found = upsert_index(index, changes.union(again), "version").collect()
    assert sorted(tuple(row) for row in found) == [
        ("a", 3, "newest"), ("b", 1, "kept"), ("c", 2, "added"),
    ]


def test_indexing_again_adds_nothing(spark, tmp_path):
    (tmp_path / "run_1_x.txt").write_text("Run ID: 1\nDataset Name: x.csv")
    index = index_reports(spark, str(tmp_path)).withColumn("version", F.lit(1))
    again = index_reports(spark, str(tmp_path)).withColumn("version", F.lit(2))
    found = upsert_index(index, again, "version").collect()
    assert [(row.doc_id, row.run_id, row.filename) for row in found] == [("run_1_x", 1, "x.csv")]


def test_metadata_forms(frame):
    df = frame(
        "doc_id string, report_path string, text string",
        ("1", "/r/run_1_x.txt", "Run ID: 7\nDataset Name:  a b.csv \n"),
        ("2", "/r/run_2_y.txt", "Run ID: pending\nno name"),
        ("3", "/r/z.txt", " Run ID: 5\nRun ID: 1\nRun ID: 2\nDataset Name: n: m.csv"),
    )
    found = {row.doc_id: (row.run_id, row.filename) for row in report_metadata(df).collect()}
    assert found == {"1": (7, "a b.csv"), "2": (-1, "run_2_y"), "3": (2, "n: m.csv")}


def test_reports_of_a_missing_folder(spark, tmp_path):
    assert read_reports(spark, str(tmp_path / "none")).count() == 0


def test_reports_written_by_others(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two\nlines\n")
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "c.csv").write_text("no")
    found = read_reports(spark, str(tmp_path))
    assert sorted((row.doc_id, row.text) for row in found.collect()) == [("a", "one"), ("b", "two\nlines\n")]
    names = report_names(found)
    assert [row.doc_id for row in names.collect()] == ["a", "b"]
    assert "text" not in names.columns


def test_csv_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "whole,gaps,real,flag,words,none,date,big\n"
        '1,1,1.5,True,"a, ""b""",NA,2024-01-01,99999999999999999999\n'
        "2,NA,1e3,false,null,,2024-01-02,1\n"
        " 3 ,#N/A,-.5,TRUE,Missing,nan,x,2\n"
    )
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {
        "whole": "bigint", "gaps": "double", "real": "double", "flag": "boolean",
        "words": "string", "none": "double", "date": "string", "big": "double",
    }
    rows = [tuple(row)[:5] for row in df.collect()]
    assert rows == [
        (1, 1.0, 1.5, True, 'a, "b"'), (2, None, 1000.0, False, None), (3, None, -0.5, True, "Missing"),
    ]


def test_formats_and_names(spark, frame, tmp_path):
    assert table_format("/x/A.CSV") == "csv"
    with pytest.raises(ValueError):
        table_format("a.xlsx")
    assert export_name(7, "csv") == "cleaned_7.csv"
    assert len(export_name(None, "csv")) == len("cleaned_.csv") + 10
    assert download_name("a.b.csv", "csv") == "a.b_cleaned.csv"
    df = frame("a int, b string", (1, "x"), (2, 'q"u'))
    for kind in ("csv", "json", "parquet"):
        path = export_table(df, str(tmp_path), 3, kind)
        assert sorted(map(tuple, read_table(spark, path, stage=True).collect())) == [(1, "x"), (2, 'q"u')]
    with pytest.raises(ValueError):
        export_table(df, str(tmp_path), 3, "xml")


def test_stream_has_one_run_per_file(spark, frame, tmp_path):
    landing, history, state = (str(tmp_path / name) for name in ("landing", "history", "state"))
    schema = "k int, v double, t string"
    for place in range(3):
        rows = [(i, float(i), "NA" if i % 2 else f"w{place}") for i in range(10 * (place + 1))]
        frame(schema, *rows).coalesce(1).write.mode("append").parquet(landing)
    from pyspark.sql.types import StructType

    kind = frame(schema).schema
    assert isinstance(kind, StructType)

    def run():
        stream = landing_stream(spark, landing, kind)
        ingest(stream, "drop", history, state, scorer="formula", exports=str(tmp_path / "out")).awaitTermination()
        return read_history(spark, history)

    first = run()
    assert sorted(row.before_total_rows for row in first.collect()) == [10, 20, 30]
    assert sorted(row.id for row in first.collect()) == [1, 2, 3]
    # Nothing new has landed.
    assert run().count() == 3
    frame(schema, (1, 1.0, "x")).coalesce(1).write.mode("append").parquet(landing)
    assert run().count() == 4
