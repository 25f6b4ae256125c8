import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from checks.tables import dirty
from conftest import SMALLEST
from plumbline import run_quality
from plumbline.operators.grouped import GROUP, fit_grouped_profile, grouped_metrics, grouped_quantiles
from plumbline.operators.order_stats import quantiles
from plumbline.plans.batch_run import FILE, run_quality_batch
from plumbline.sources.history import read_history
from plumbline.sources.readers import read_reports, read_table
from plumbline.sources.report_index import read_index
from plumbline.streaming.ingest import ingest, landing_stream

MOMENT = dt.datetime(2024, 5, 6, 7, 8, 9)
SCHEMA = "k int, v double, t string, u string, b boolean, d date, c string"


def tables():
    """Files that differ in every metric: skewed, mixed, constant, empty columns, copies, ties, markers."""
    turn = random.Random(3)
    day = dt.date(2024, 1, 1)

    def row(i, v, t, u, b=True, c="K"):
        return i, v, t, u, b, day, c

    skewed = [row(i, float(2 ** (i % 14)), turn.choice(["a", "b", None, "N/A"]), f"{i}" if i % 3 else "x") for i in range(60)]
    copies = [row(i % 20, float(i % 20), "same", None, i % 20 < 10) for i in range(50)]
    gaps = [row(i, None if i % 4 == 0 else float(i), f"w{i % 9}", f"u{i}", None if i % 5 == 0 else True) for i in range(40)]
    gaps += [row(900, 1e6, "w1", None)]
    infinite = [row(i, float("inf") if i % 2 else float(i), "-", "7") for i in range(8)]
    single = [row(1, None, None, None, None, None)]
    spotless = [row(i, float(i), f"t{i}", f"s{i}", i % 2 == 0, str(i)) for i in range(30)]
    return {
        "/in/a/skewed.csv": skewed, "/in/copies.csv": copies, "/in/b/gaps x.csv": gaps, "/in/infinite.csv": infinite,
        "/in/single.csv": single, "/in/spotless.csv": spotless,
    }


@pytest.fixture(scope="module")
def batch(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("batch"))
    rows = [(*r, path) for path, each in tables().items() for r in each]
    df = spark.createDataFrame(rows, f"{SCHEMA}, {FILE} string")
    done = run_quality_batch(
        df, scorer="formula", history=f"{folder}/history", reports=f"{folder}/reports", exports=f"{folder}/out",
        index=f"{folder}/index", created_at=MOMENT, run_key="b1",
    )
    return done, folder, df


def plain(value):
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return round(value, 9) if isinstance(value, float) else value


def test_every_file_as_if_alone(spark, batch):
    done, _, _ = batch
    assert not done.failures
    found = {row.filename: row for row in done.results.collect()}
    assert len(found) == 6
    for path, rows in tables().items():
        name = path.rpartition("/")[2]
        alone = run_quality(spark.createDataFrame(rows, SCHEMA), name, scorer="formula", created_at=MOMENT)
        wanted = alone.result.first()
        for field in ("before", "after", "cleaning_report", "was_cleaned", "confidence_level", "threshold", "status"):
            assert plain(found[name][field]) == plain(wanted[field]), (name, field)
        if alone.was_cleaned:
            number = [p for p, r in enumerate(sorted(tables())) if r == path][0]
            mine = done.frame.where(F.col(GROUP) == number).drop(GROUP)
            texts = [F.col(c).cast("double").alias(c) if c in "kv" else F.col(c).cast("string").alias(c) for c in mine.columns]
            key = lambda r: tuple(str(x) for x in r)
            assert sorted(map(tuple, mine.select(*texts).collect()), key=key) == sorted(
                map(tuple, alone.frame.select(*texts).collect()), key=key
            ), name


def test_batch_is_recorded(spark, batch):
    done, folder, df = batch
    history = read_history(spark, f"{folder}/history")
    assert sorted(r.id for r in history.collect()) == [1, 2, 3, 4, 5, 6]
    found = {row.filename: row for row in done.results.collect()}
    reports = {row.doc_id: row.text for row in read_reports(spark, f"{folder}/reports").collect()}
    assert reports == {f"run_{r.run_id}_{r.filename[:-4].replace(' ', '_')}": r.report for r in found.values()}
    index = {row.doc_id: row for row in read_index(spark, f"{folder}/index").collect()}
    assert {k: r.text for k, r in index.items()} == reports
    assert {r.filename for r in index.values()} == set(found)
    for row in found.values():
        assert row.was_cleaned == (row.download_path is not None)
        if row.was_cleaned:
            back = read_table(spark, row.download_path)
            assert row.download_path.endswith(f"cleaned_{row.run_id}.csv")
            assert back.columns == SCHEMA.replace(",", "").split()[::2] and back.count() == row.after.total_rows
    # The same batch again replaces.
    again = run_quality_batch(df, scorer="formula", history=f"{folder}/history", created_at=MOMENT, run_key="b1")
    assert again.run_ids == done.run_ids and read_history(spark, f"{folder}/history").count() == 6


def test_jobs_do_not_grow_with_files(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(files, name):
        rows = [(i % 7, float(i), "NA" if i % 5 == 0 else f"w{i % 3}", f"/in/{i % files}.csv") for i in range(400)]
        df = spark.createDataFrame(rows, f"k int, v double, t string, {FILE} string")
        spark.sparkContext.setJobGroup(name, name)
        # All files are cleaned, whatever their score.
        run_quality_batch(df, scorer="formula", threshold=101.0, created_at=MOMENT)
        spark.sparkContext.setJobGroup("other", "other")
        return len(tracker.getJobIdsForGroup(name))

    few, many = jobs(8, "few files"), jobs(40, "many files")
    assert many < 2 * few


def test_grouped_quantiles_equal_single_ones(spark):
    turn = random.Random(1)
    rows = [(i % 3, turn.choice([float(i), 5.0, -1e300, 1e300, float("inf"), 1e-9 * i, None])) for i in range(900)]
    df = spark.createDataFrame(rows, f"{GROUP} int, v double")
    counts = {(g, "v"): sum(1 for r in rows if r[0] == g and r[1] is not None) for g in range(3)}
    found = grouped_quantiles(df, counts, (0.25, 0.5, 0.75))
    for g in range(3):
        part = df.where(F.col(GROUP) == g)
        assert found[g, "v"] == quantiles(part, {"v": F.col("v")}, {"v": counts[g, "v"]}, (0.25, 0.5, 0.75))["v"]


def test_batch_with_a_row_key(spark):
    whole = dirty(spark, SMALLEST)
    df = whole.withColumn(FILE, F.lit("/x/orders.csv")).unionByName(
        whole.where("row_id % 3 = 0").withColumn(FILE, F.lit("/x/third.csv"))
    )
    done = run_quality_batch(df, key="row_id", scorer="formula", created_at=MOMENT)
    found = {row.filename: row for row in done.results.collect()}
    for name, part in (("orders.csv", whole), ("third.csv", whole.where("row_id % 3 = 0"))):
        wanted = run_quality(part, name, "row_id", scorer="formula", created_at=MOMENT).result.first()
        for field in ("before", "after", "cleaning_report"):
            assert plain(found[name][field]) == plain(wanted[field]), (name, field)


def test_empty_batch(spark):
    done = run_quality_batch(spark.createDataFrame([], f"v int, {FILE} string"), scorer="formula")
    assert done.results.count() == 0 and done.run_ids == {}


def test_failing_steps_keep_the_run(spark, frame, tmp_path):
    """A folder that is a file cannot be written to."""
    blocked = tmp_path / "file"
    blocked.write_text("x")
    rows = [(i % 5, "NA") for i in range(20)]
    run = run_quality(
        frame("v int, t string", *rows), "a.csv", scorer="formula", created_at=MOMENT,
        history=f"{blocked}/h", reports=f"{blocked}/r", index=f"{blocked}/i", exports=str(tmp_path / "out"),
    )
    assert set(run.failures) == {"history", "report", "index"}
    row = run.result.first()
    assert row.status == "SUCCESS" and row.run_id is None and row.report_path is None
    assert "Run ID: pending" in row.report and run.export_path
    df = frame("v int, t string", *rows).withColumn(FILE, F.lit("/x/a.csv"))
    batch = run_quality_batch(df, scorer="formula", history=f"{blocked}/h", reports=f"{blocked}/r", created_at=MOMENT)
    assert set(batch.failures) == {"history", "report"} and batch.results.first().run_id is None


def test_stream_of_several_files_a_batch(spark, frame, tmp_path):
    landing, history, state = (str(tmp_path / name) for name in ("landing", "history", "state"))
    schema = "k int, v double, t string"
    for place in range(3):
        rows = [(i % 7, float(i % 7), "NA" if i % 2 else f"w{place}") for i in range(10 * (place + 1))]
        frame(schema, *rows).coalesce(1).write.mode("append").parquet(landing)
    names = sorted(p.name for p in (tmp_path / "landing").glob("*.parquet"))

    def run():
        stream = landing_stream(spark, landing, frame(schema).schema)
        ingest(
            stream, "drop", history, state, scorer="formula", exports=str(tmp_path / "out"),
            reports=str(tmp_path / "reports"), index=str(tmp_path / "index"), created_at=MOMENT,
        ).awaitTermination()
        return read_history(spark, history).collect()

    first = run()
    assert sorted(row.filename for row in first) == names
    assert sorted(row.before_total_rows for row in first) == [10, 20, 30] and all(row.was_cleaned for row in first)
    assert read_reports(spark, str(tmp_path / "reports")).count() == read_index(spark, str(tmp_path / "index")).count() == 3
    assert len(run()) == 3


def test_stream_whose_history_fails_is_repeated(spark, frame, tmp_path):
    landing = str(tmp_path / "landing")
    frame("v int", 1, 2, 3).coalesce(1).write.parquet(landing)
    (tmp_path / "file").write_text("x")
    stream = landing_stream(spark, landing, frame("v int").schema)
    query = ingest(stream, "drop", f"{tmp_path}/file/h", str(tmp_path / "state"), scorer="formula")
    with pytest.raises(Exception, match="not recorded"):
        query.awaitTermination()


def test_grouped_metrics_of_no_usable_fence(spark):
    df = spark.createDataFrame([(0, 1.0, "x"), (1, None, None)], f"{GROUP} int, v double, t string")
    found = {row[GROUP]: row for row in grouped_metrics(fit_grouped_profile(df)).collect()}
    assert found[0].outlier_pct == 0.0 and found[1].missing_pct == 100.0


def test_large_file_is_shared_by_many_tasks(spark, tmp_path, monkeypatch):
    """A file of one row group is read by one task, the batch that is stored from it by several."""
    from plumbline.plans import batch_run

    folder, seen = str(tmp_path / "one"), []
    fit = batch_run.fit_grouped_profile
    monkeypatch.setattr(batch_run, "ROW_GROUP", 1 << 14, raising=False)
    monkeypatch.setattr(batch_run, "fit_grouped_profile", lambda table, *rest: seen.append(table) or fit(table, *rest))
    spark.range(0, 40_000, 1, 1).select("id", F.rand(1).alias("v")).write.parquet(folder)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = spark.read.parquet(folder).withColumn(FILE, F.lit("/x/one.parquet"))
        done = run_quality_batch(df, scorer="formula", threshold=0.0)
        busy = seen[0].groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    (row,) = done.results.collect()
    assert row.before.total_rows == sum(part["count"] for part in busy) == 40_000
    assert len(busy) > 3


def test_names_of_landed_files_are_decoded(spark, tmp_path):
    names = ["plain.parquet", "with space.parquet", "per%20cent.parquet", "plus+sign.parquet", "ümlaut + %.parquet"]
    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "source"))
    (source,) = (tmp_path / "source").glob("*.parquet")
    (tmp_path / "landing").mkdir()
    for name in names:
        (tmp_path / "landing" / name).write_bytes(source.read_bytes())
    found = []
    stream = landing_stream(spark, str(tmp_path / "landing"), spark.range(1).schema)
    writer = stream.writeStream.foreachBatch(lambda batch, _: found.extend(batch.collect()))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(row[FILE].rpartition("/")[2] for row in found) == sorted(names)
