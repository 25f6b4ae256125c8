import pytest
import math
import random
from collections import Counter


from plumbline.limits import Limits
from plumbline.operators.retrieve import (
    NO_MATCH,
    assemble_context,
    group_centroids,
    text_topk,
    vector_topk,
)

INDEX = "doc_id bigint, run_id int, filename string, report_path string, text string"
QUESTIONS = "question_id bigint, question string, run_id int, filename string"
ONE_BATCH = Limits()
MANY_BATCHES = Limits(question_values=4, question_terms=3)


def _brute_force(docs, question, k=5):
    tf = {d: Counter(text.lower().split()) for d, text in docs.items()}
    df = Counter(term for counts in tf.values() for term in counts)
    weights = {
        term: (1 + math.log(n)) * math.log((len(docs) + 1) / (df[term] + 1))
        for term, n in Counter(question.lower().split()).items()
    }
    q_size = math.sqrt(sum(w * w for w in weights.values())) or 1.0
    scores = {}
    for d, counts in tf.items():
        own = {t: 1 + math.log(n) for t, n in counts.items()}
        size = math.sqrt(sum(w * w for w in own.values())) or 1.0
        scores[d] = round(sum(own[t] / size * w / q_size for t, w in weights.items() if t in own), 6)
    return sorted(scores.items(), key=lambda item: (-item[1], item[0]))[:k]


def test_text_topk_is_brute_force(frame):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    docs = {i: " ".join(rng.choices(words, k=rng.randint(1, 12))) for i in range(40)}
    questions = {i: " ".join(rng.choices(words + ["other"], k=3)) for i in range(6)}
    index = frame(INDEX, *[(i, i, "f", "p", text) for i, text in docs.items()])
    asked = frame(QUESTIONS, *[(i, text, None, None) for i, text in questions.items()])
    for limits in (ONE_BATCH, MANY_BATCHES):
        found = text_topk(index, asked, limits=limits).orderBy("question_id", "rank").collect()
        for number, question in questions.items():
            got = [(r.doc_id, r.score) for r in found if r.question_id == number]
            expected = _brute_force(docs, question)
            assert [d for d, _ in got] == [d for d, _ in expected]
            assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, expected))


def test_documents_without_common_words_fill_up(frame):
    index = frame(INDEX, (1, 1, "f", "p", "apple"), (2, 2, "f", "p", "pear"), (3, 3, "f", "p", ""))
    asked = frame(QUESTIONS, (1, "pear", None, None), (2, "???", None, None))
    found = text_topk(index, asked).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.doc_id) for r in found] == [(1, 2), (1, 1), (1, 3), (2, 1), (2, 2), (2, 3)]


def test_scopes_and_context(frame):
    index = frame(
        INDEX,
        (1, 10, "a.csv", "p1", "missing values fixed"),
        (2, 10, "a.csv", "p2", "missing rows"),
        (3, 11, "b.csv", "p3", "missing values"),
        (4, 12, "b.csv", "p4", "other"),
    )
    asked = frame(
        QUESTIONS,
        (1, "missing values", 10, "b.csv"),
        (2, "missing values", 99, "b.csv"),
        (3, "missing values", 99, None),
        (4, "missing values", 99, ""),
        (5, "missing values", None, "b.csv"),
    )
    found = text_topk(index, asked)
    got = {}
    for row in found.orderBy("question_id", "rank").collect():
        got.setdefault(row.question_id, []).append(row.doc_id)
    assert got == {1: [1, 2], 2: [3, 4], 5: [3, 1, 2, 4]}
    context = {row.question_id: row for row in assemble_context(asked, found, index).collect()}
    assert context[1].context == "missing values fixed\n\nmissing rows"
    assert [tuple(source) for source in context[2].sources] == [(11, "b.csv", "p3"), (12, "b.csv", "p4")]
    assert (context[3].context, context[3].sources) == (NO_MATCH, [])


def test_vector_topk(frame):
    rng = random.Random(9)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(4)] for i in range(30)}
    vectors[30] = [0.0] * 4
    asked = {i: [rng.uniform(-1, 1) for _ in range(4)] for i in range(5)}
    index = frame("doc_id bigint, vector array<double>", *vectors.items())
    questions = frame("question_id bigint, vector array<double>", *asked.items())

    def cosine(a, b):
        size = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    for limits in (ONE_BATCH, MANY_BATCHES):
        found = vector_topk(index, questions, 3, limits).orderBy("question_id", "rank").collect()
        for number, vector in asked.items():
            expected = sorted(vectors, key=lambda d: (-round(cosine(vector, vectors[d]), 6), d))[:3]
            assert [r.doc_id for r in found if r.question_id == number] == expected


def test_centroids(frame):
    df = frame("label int, vector array<double>", (1, [0.0, 2.0]), (1, [2.0, 4.0]), (2, [1.0, 1.0]))
    found = {row.question_id: row.vector for row in group_centroids(df, "label").collect()}
    assert found == {1: [1.0, 3.0], 2: [1.0, 1.0]}


def test_ranking_is_cut_before_the_shuffle(frame):
    index = frame("doc_id bigint, vector array<double>", (1, [1.0]))
    questions = frame("question_id bigint, vector array<double>", (1, [1.0]))
    plan = vector_topk(index, questions)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Join" not in plan


def test_equal_vectors_are_ranked_by_id(frame):
    index = frame("doc_id string, vector array<float>", *[(f"d{i:03d}", [1.0, 1.0]) for i in range(200)])
    questions = frame("question_id string, vector array<double>", ("q", [2.0, 2.0]), ("r", [0.0, 1.0]))
    found = vector_topk(index, questions, 2).orderBy("question_id", "rank").collect()
    assert [tuple(row) for row in found] == [
        ("q", 1, "d000", 1.0), ("q", 2, "d001", 1.0),
        ("r", 1, "d000", 0.707107), ("r", 2, "d001", 0.707107),
    ]


def test_odd_vectors_score_nothing_and_hide_nothing(spark):
    inf = float("inf")
    rows = [(i, [1.0, float(i)]) for i in range(1, 7)]
    rows += [(7, [inf, 1.0]), (8, [float("nan"), 1.0]), (9, [1.0]), (10, [1.0, 2.0, 3.0]), (11, None), (12, [0.0, 0.0])]
    index = spark.createDataFrame(rows, "doc_id int, vector array<double>")
    questions = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "question_id int, vector array<double>")
    found = vector_topk(index, questions, 11).orderBy("rank").collect()
    assert {row.question_id for row in found} == {1}
    assert [row.doc_id for row in found] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12]
    assert all(row.score == 0 for row in found[6:])
    mixed = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], questions.schema)
    with pytest.raises(ValueError, match="different lengths"):
        vector_topk(index, mixed, 2)
