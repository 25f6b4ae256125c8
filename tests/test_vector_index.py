import math

import numpy as np
import pytest
from plumbline.limits import Limits
from plumbline.operators.retrieve import vector_topk
from plumbline.operators.vector_index import build_vector_index, recall_at_k, search_vectors

VECTORS, ASKED = "doc_id long, vector array<float>", "question_id long, vector array<float>"


def _clusters(count=1500, kinds=30, dimensions=24):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((kinds, dimensions))
    return [(i, (centers[i % kinds] + 0.2 * rng.standard_normal(dimensions)).tolist()) for i in range(count)]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rows = _clusters()
    index = spark.createDataFrame(rows, VECTORS)
    path = str(tmp_path_factory.mktemp("index") / "clusters")
    build_vector_index(index, path, sides=6, directions=12)
    questions = spark.createDataFrame([row for row in rows if row[0] % 100 == 0], ASKED)
    return index, path, questions


def _rows(df):
    return sorted(tuple(row) for row in df.select("question_id", "rank", "doc_id", "score").collect())


def test_exact_search_equals_scoring_all(clustered):
    index, path, questions = clustered
    expected = _rows(vector_topk(index, questions))
    # From two thresholds, and from many batches.
    for share, limits in ((0.05, Limits()), (0.4, Limits()), (0.05, Limits(question_values=300))):
        found = search_vectors(path, questions, share=share, limits=limits)
        assert _rows(found.matches) == expected
        assert 0 < found.scored_pairs < found.all_pairs == 15 * 1500


def test_recall_of_first_buckets(clustered):
    index, path, questions = clustered
    exact = vector_topk(index, questions)
    recalls = {}
    for share in (None, 1.0):
        found = search_vectors(path, questions, exact=False, share=share)
        recalls[share] = recall_at_k(found.matches, exact)
    assert recalls[None] >= 0.9
    assert recalls[1.0] == 1.0


def test_recall_on_unclustered_vectors(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr(
        "vec_id AS doc_id", "embedding AS vector"
    )
    questions = vectors.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "question_id")
    build_vector_index(vectors, str(tmp_path / "i"))
    found = search_vectors(str(tmp_path / "i"), questions, exact=False)
    assert found.scored_pairs < 0.65 * found.all_pairs
    assert recall_at_k(found.matches, vector_topk(vectors, questions)) >= 0.9


def test_odd_vectors_ties_and_repeats(frame, tmp_path):
    nan, inf = math.nan, math.inf
    index = frame(
        "doc_id long, vector array<float>, bucket string",
        (1, [1.0, 0.0], "x"),
        (2, [2.0, 0.0], "x"),
        (2, [2.0, 0.0], "x"),
        (3, [0.0, 0.0], None),
        (4, [inf, 1.0], None),
        (5, [nan, 1.0], None),
        (6, [1.0], None),
        (7, None, None),
        (8, [], None),
        (None, [-1.0, 0.0], None),
        (9, [0.6, 0.8], None),
        (10, [1.0, None], None),
    )
    questions = frame(
        ASKED, (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, [inf, 0.0]), (5, None)
    )
    path = str(tmp_path / "i")
    build_vector_index(index, path)
    found = search_vectors(path, questions, k=20)
    by_question = {}
    for q, _, doc, score in sorted(found.matches.collect()):
        by_question.setdefault(q, []).append((doc, score))
    assert by_question[1][:4] == [(1, 1.0), (2, 1.0), (2, 1.0), (9, 0.6)]
    assert by_question[1][-1] == (None, -1.0)
    assert by_question[3][0] == (None, 1.0)
    assert all(len(rows) == 11 for rows in by_question.values())
    assert {score for q in (2, 4) for _, score in by_question[q]} == {0.0}
    assert set(by_question) == {1, 2, 3, 4}


def test_empty_index_and_wrong_questions(frame, tmp_path):
    path = str(tmp_path / "none")
    build_vector_index(frame(VECTORS), path)
    assert search_vectors(path, frame(ASKED, (1, [1.0]))).matches.count() == 0
    path = str(tmp_path / "two")
    build_vector_index(frame(VECTORS, (1, [1.0, 2.0])), path)
    with pytest.raises(ValueError):
        search_vectors(path, frame(ASKED, (1, [1.0])))
    with pytest.raises(ValueError):
        search_vectors(path, frame(ASKED, (1, [1.0, 1.0])), k=0)
    assert search_vectors(path, frame(ASKED)).matches.count() == 0
