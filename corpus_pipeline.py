"""A training corpus from raw documents, in five stages.  Each stage reads what the one before kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.decontaminate import contamination
from plumbline.llm.ngram_join import jaccard_join
from plumbline.llm.pieces import encode, load_model
from plumbline.llm.pii import fit_field, redact
from plumbline.llm.quality import assess, trusted_ids
from plumbline.llm.rows import with_row_keys, without_rows
from plumbline.storage import settle

# Five-word shingles and a similarity of 0.8 make near duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 80
ROW = "__row"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = assess(docs, trusted_ids(labels), name="__quality")
    return judged.where("__quality.kept").drop("__quality")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Documents without words are in no group and stay.  Rows are judged each for itself: of rows
    with the same text one stays, whether their ids are equal, different or null, and rows of one
    id with different texts have nothing to do with each other."""
    keyed = with_row_keys(docs, ROW)
    members = jaccard_join(keyed, id_column=ROW, n=SHINGLE_WORDS, percent=SIMILARITY).members
    gone = members.where("id <> component").select(F.col("id").alias(ROW))
    return without_rows(keyed, gone, ROW).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of a benchmark passage; rows are judged each for itself, whatever
    their ids."""
    keyed = with_row_keys(docs, ROW)
    texts = keyed.select(F.col(ROW).alias("doc_id"), "text")
    found = contamination(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("n_hit > 0").select(F.col("doc_id").alias(ROW))
    return without_rows(keyed, hit, ROW).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every personal datum replaced by its kind; ``n_chars`` counts the new text."""
    clean = redact(docs, fit_field(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    return encode(docs, load_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", tokens),
]

# Hashed likelihood ratios, the trained field and the piece automaton are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
