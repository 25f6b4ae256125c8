"""Small tables with every awkward case, and plain definitions to hold the operators against."""

from __future__ import annotations

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}

#: Ids that repeat or are null, null, empty and long texts, ties, and columns with clashing names.
SCHEMA = (
    "doc_id long, text string, id long, n long, token string, size int, shard int, slot int, held boolean,"
    " block long, quality string, score double, word string, lang string, source string, n_chars long"
)
BASE = "the quick brown fox jumps over the lazy dog and runs far away from all the noise of the town"
TEXTS = [
    (1, BASE),
    (2, BASE.upper()),
    (3, BASE + " today"),
    (4, "one two"),
    (5, "One  TWO\n"),
    (6, ""),
    (7, None),
    (8, " \t\n"),
    (9, "ünïcödé wörds ärë hêrë tøo, ñ and 漢字 and 😀"),
    (10, "long " * 3000 + BASE),
    (11, BASE),
    (11, BASE),
    (12, "a"),
    (None, BASE + " tomorrow"),
    (None, None),
    (13, "nul\x00byte in the middle of some words that go on and on"),
    (14, "mail bob.x@mail.example.com or +1 (555) 123-4567 from 10.1.2.3 with 4111 1111 1111 1111."),
]


def messy(spark):
    rows = [
        (i, t, 5, 6, "t", 7, 8, 9, True, 10, "q", 0.5, "w", "en", "s", len(t or "")) for i, t in TEXTS
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None, lower: bool = True) -> list[str]:
    found = WORD.findall(text or "")
    return [w.translate(LOWER) for w in found] if lower else found


def from_files(spark, name: str, rows: int | None = None):
    found = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    return found if rows is None else found.orderBy(found.columns[0]).limit(rows)
