import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SMALLEST
from plumbline.operators.postings import build_postings, postings_topk
from plumbline.operators.retrieve import text_topk
from plumbline.sources.csv_ranges import csv_records
from plumbline.sources.readers import _csv_text, infer_types, read_csv

INDEX = "doc_id bigint, run_id int, filename string, report_path string, text string"
QUESTIONS = "question_id bigint, question string, run_id int, filename string"


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few hundred bytes, so that a small file has many tasks."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    spark.conf.set(names[0], "300b")
    spark.conf.set(names[1], "0b")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def same_rows(a, b):
    """But for line ends in cells of files whose own line ends are CRLF: Spark's parser rewrites
    them there, ranges keep them."""
    assert a.columns == b.columns and a.dtypes == b.dtypes

    def rows(df):
        return sorted(tuple(str(v).replace("\r\n", "\n") for v in row) for row in df.collect())

    assert rows(a) == rows(b)


CELLS = ["plain", "", "a,b", "line\nbreak", "two\n\nbreaks", 'quo"te', '"', "\r\n", " spaced ", "ünï漢😀", "x" * 700, "\n" * 40, "NA", "7"]


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"'


@pytest.mark.parametrize("seed", range(4))
def test_ranges_parse_as_one_task_does(spark, tmp_path, small_ranges, seed):
    turn = random.Random(seed)
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for number in range(2):
        end = "\r\n" if seed % 2 else "\n"
        lines = ["id,first name,b"]
        for i in range(turn.randrange(0, 60)):
            cells = [quoted(c) if turn.random() < 0.5 or set(c) & set(',"\r\n') else c for c in turn.choices(CELLS, k=2)]
            lines.append(",".join([str(i), *cells]))
            if turn.random() < 0.05:
                lines.append("")
        (folder / f"{number}.csv").write_bytes((end.join(lines) + (end if turn.random() < 0.5 else "")).encode())
    wanted = infer_types(_csv_text(spark, str(folder), ",", True))
    same_rows(read_csv(spark, str(folder), multiline=True), wanted)


def test_one_file_has_many_tasks(spark, tmp_path, small_ranges):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f'{i},"line {i}\nand more"\n' for i in range(200)))
    found = csv_records(spark, str(path))
    assert found.rdd.getNumPartitions() > 5 and found.where("kind = 0").select("start").distinct().count() > 5
    assert read_csv(spark, str(path), multiline=True).count() == 200


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    path = tmp_path / "t.csv"
    long = "word\n" * 1000
    path.write_text(f'a,b\n1,"{long}"\n2,short\n3,"{long}"')
    rows = {row.a: row.b for row in read_csv(spark, str(path), multiline=True).collect()}
    assert rows == {1: long, 2: "short", 3: long}


def test_csv_without_rows(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n")
    found = read_csv(spark, str(path), multiline=True)
    assert found.columns == ["a", "b"] and found.count() == 0


def lists(found):
    out = {}
    for row in found.orderBy("question_id", "rank").collect():
        out.setdefault(row.question_id, []).append((row.rank, row.doc_id, row.score))
    return out


def close(a, b):
    assert a.keys() == b.keys()
    for question in a:
        assert [(r, d) for r, d, _ in a[question]] == [(r, d) for r, d, _ in b[question]], question
        assert all(abs(x - y) < 2e-6 for (*_, x), (*_, y) in zip(a[question], b[question]))


@pytest.mark.parametrize("seed", range(2))
def test_postings_equal_the_scan(spark, frame, tmp_path, seed):
    turn = random.Random(seed)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    texts = [
        " ".join(turn.choices(common, k=turn.randrange(1, 200)) + turn.choices(rare, k=turn.randrange(0, 4)))
        for _ in range(400)
    ]
    texts += ["", None, "w1", "w1", "W1 w1", "?!", "long " * 20_000]
    index = frame(INDEX, *[(i, i, "f", "p", text) for i, text in enumerate(texts)])
    asked = [(i, " ".join(turn.choices(common, k=2) + turn.choices(rare, k=1)), None, None) for i in range(15)]
    asked += [(100, "nothing known", None, None), (101, "", None, None), (102, "w1", None, None), (103, "r1 r1 r2", None, None)]
    questions = frame(QUESTIONS, *asked)
    path = str(tmp_path / "postings")
    build_postings(index, path, block_documents=16, term_buckets=8)
    search = postings_topk(spark, path, questions, 3, first_blocks=2)
    close(lists(search.matches), lists(text_topk(index.fillna({"text": ""}), questions, 3)))
    assert 0 < search.read_blocks < search.all_blocks


def test_postings_skip_most_blocks_for_rare_words(spark, frame, tmp_path):
    texts = [f"usual words here {'needle' if i == 777 else 'hay'} {i}" for i in range(2000)]
    index = frame(INDEX, *[(i, i, "f", "p", text) for i, text in enumerate(texts)])
    path = str(tmp_path / "postings")
    build_postings(index, path, block_documents=50)
    search = postings_topk(spark, path, frame(QUESTIONS, (1, "needle", None, None)), 1)
    assert search.matches.first().doc_id == 777
    assert search.read_blocks == 1 and search.all_blocks > 20


def test_postings_come_out_of_a_block_as_the_best_of_each_question(spark, frame, tmp_path):
    rows = [(i, None, None, None, f"common water house {'day ' * (i % 5)}n{i}") for i in range(300)]
    index = spark.createDataFrame([(i, t) for i, *_, t in rows], "doc_id long, text string")
    path = str(tmp_path / "postings")
    build_postings(index, path, block_documents=1000)
    asked = [(q, f"common water house day n{q}", None, None) for q in range(40)]
    search = postings_topk(spark, path, frame(QUESTIONS, *asked), 3, first_blocks=1)
    best = {row.question_id: row.doc_id for row in search.matches.where("rank = 1").collect()}
    assert best == {q: q for q in range(40)} and search.matches.count() == 120
    # No row per question and document.
    assert "inline(entries" not in search.matches._jdf.queryExecution().toString()


def test_postings_of_nothing(spark, frame, tmp_path):
    path = str(tmp_path / "postings")
    build_postings(spark.createDataFrame([], INDEX), path)
    assert postings_topk(spark, path, frame(QUESTIONS, (1, "a", None, None))).matches.count() == 0


def test_restricted_questions_read_their_scope_only(spark, frame):
    index = frame(INDEX, *[(i, i // 10, f"f{i % 4}", "p", f"word{i % 5} text") for i in range(100)])
    from plumbline.operators.retrieve import in_scope, question_scopes

    asked = frame(QUESTIONS, (1, "word1", 3, "f1"), (2, "word1", 99, "f2"), (3, "word1", 99, None))
    scopes = question_scopes(index, asked).toPandas()
    assert in_scope(index, scopes).where("run_id <> 3 AND filename <> 'f2'").count() == 0
    found = lists(text_topk(index, asked, 2))
    assert set(found) == {1, 2} and all(30 <= d < 40 for _, d, _ in found[1]) and all(d % 4 == 2 for _, d, _ in found[2])


def test_training_rows_do_not_depend_on_partitions(spark):
    from plumbline.operators.forest import training_table

    rows = training_table(spark).collect()
    assert len(rows) == 1500 and rows == training_table(spark).repartition(7).orderBy("row").collect()
    noise = [r.trust_score for r in rows]
    assert min(noise) >= 0 and max(noise) <= 100 and len(set(noise)) > 1000
