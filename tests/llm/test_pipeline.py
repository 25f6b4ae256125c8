import pytest
from pyspark.sql import functions as F

from helpers import BASE, empty, from_files, messy
from test_decontaminate import brute as contaminated
from test_ngram_join import brute as groups
from test_pii import brute as personal

pytest.importorskip("plumbline.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from plumbline.llm.pieces import decode_ids, load_model  # noqa: E402
from plumbline.llm.quality import fit_quality, judge, trusted_ids  # noqa: E402
from plumbline.storage import settle  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_stage_against_its_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        after = settle(stage(spark, docs, SF), name)
        if name != "sentencepiece":
            assert after.columns == docs.columns
        kept[name] = docs, after
        docs = after
    before, after = kept["quality_rules"]
    judged = judge(before, fit_quality(before, trusted_ids(from_files(spark, "labels"))))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in judged.where("quality.kept").collect()}

    before, after = kept["near_duplicates"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    component = groups(rows, 5, 80)
    assert {r.doc_id for r in after.collect()} == {i for i, c in component.items() if i == c}

    before, after = kept["decontamination"]
    items = [(r.item_id, r.text) for r in from_files(spark, "benchmark").collect()]
    hits = contaminated([(r.doc_id, r.text) for r in before.collect()], items)
    assert {r.doc_id for r in after.collect()} == {i for i, _, hit, _ in hits if not hit}

    before, after = kept["personal_data"]
    texts = {r.doc_id: r.text for r in before.collect()}
    clean = {r.doc_id: r for r in after.collect()}
    assert set(clean) == set(texts)
    for i, text in texts.items():
        assert clean[i].n_chars == len(clean[i].text)
        assert all(text[a:b] not in clean[i].text for a, _, b in personal(text))

    model = load_model()
    before, after = kept["sentencepiece"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id: decode_ids(model.spelled, r.pieces) for r in after.collect()} == texts
    whole = {(r.doc_id, tuple(r.pieces)) for r in pipeline.run(spark, SF).collect()}
    assert whole == {(r.doc_id, tuple(r.pieces)) for r in after.collect()}


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], DOCUMENT)


def test_rows_are_judged_each_for_itself(spark):
    """Null and repeated ids neither save a row nor cost another one."""
    (item,) = from_files(spark, "benchmark", 1).collect()
    other = " ".join(f"word{k}" for k in range(30))
    pairs = [(1, BASE), (1, BASE), (None, BASE), (1, other), (None, item.text), (2, item.text), (2, other + " more and more text")]
    pairs += [(None, None), (None, None), (3, ""), (3, "short")]
    docs = rows_of(spark, pairs)
    after = pipeline.near_duplicates(spark, docs, SF)
    texts = [r.text for r in after.collect()]
    assert after.columns == docs.columns
    assert texts.count(BASE) == texts.count(item.text) == 1
    assert texts.count(None) == 2 and "" in texts and "short" in texts
    assert sum(t is not None and t.startswith(other) for t in texts) in (1, 2)
    clean = pipeline.decontamination(spark, docs, SF)
    kept = [(r.doc_id, r.text) for r in clean.collect()]
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(kept, key=key) == sorted([p for p in pairs if p[1] != item.text], key=key)


def test_row_keys(spark):
    from plumbline.llm.rows import with_row_keys

    for ids in ([1, 2, 3], [1, 1, None, None, 5], [1 << 62, 7, 7], [(1 << 63) - 1, -(1 << 63), 4, 4], [None], []):
        df = spark.createDataFrame([(i, "t") for i in ids], "doc_id long, text string")
        rows = with_row_keys(df, "key").collect()
        assert len(rows) == len(ids) == len({r.key for r in rows})
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
        alone = {i for i in ids if ids.count(i) == 1 and i is not None}
        if len(ids) != 4:
            assert {r.doc_id for r in rows if r.key == r.doc_id} >= alone


@pytest.mark.parametrize("make", [messy, empty])
def test_messy_rows_through_every_stage(spark, make):
    docs = make(spark)
    for name, stage in pipeline.STAGES:
        after = settle(stage(spark, docs, SF), name)
        if name != "sentencepiece":
            assert after.columns == docs.columns
            docs = after
    assert after.count() == docs.count()
    assert make is empty or after.count() > 0


@pytest.mark.parametrize("stage", [pipeline.near_duplicates, pipeline.decontamination])
def test_dropping_rows_moves_no_text(spark, monkeypatch, stage):
    """The few keys go to the rows; more than a task may hold are shuffled, with the same result."""
    from plumbline.llm import rows

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = stage(spark, docs, SF)
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        few = sorted(few.collect())
        monkeypatch.setattr(rows, "KEYS_AT_ONCE", -1)
        many = stage(spark, docs, SF)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert few == sorted(many.collect()) and 0 < len(few) < docs.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
