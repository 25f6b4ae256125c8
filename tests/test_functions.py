import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions.formats import delta_text, file_stem, percent_text
from plumbline.functions.rounding import round_exact
from plumbline.functions.tokens import is_missing_token, is_number


def _flags(frame, predicate, values):
    rows = frame("v string", *values).select(predicate(F.col("v"))).collect()
    return [row[0] for row in rows]


def test_missing_tokens_are_stripped_and_lowered(frame):
    missing = ["", " NA ", "n/a", "\tNull", "none\n", "MISSING", "-", "--", "nan", "Unknown"]
    missing += [" na ", "unKnown", "\x1cnone\x85", "   "]
    kept = ["ok", "n a", "---", "nanny", "mıssıng", "miſſing", "unknown value", "0"]
    assert all(_flags(frame, is_missing_token, missing))
    assert not any(_flags(frame, is_missing_token, kept))
    tokens = {"", "na", "n/a", "nan", "null", "none", "missing", "unknown", "-", "--"}
    for value in missing + kept:
        assert (value.strip().lower() in tokens) == (value in missing), value


def test_long_text_is_read_whole(frame):
    values = [" " * 5000 + "na" + "\t" * 5000, " " * 5000 + "na" + " x"]
    assert _flags(frame, is_missing_token, values) == [True, False]


def test_number_words(frame):
    values = ["1d", "1_000", "nan", "1e5", " 1 ", "inf", "-.5", "+3.", "1e", ".", "0x1f", "Infinity"]
    expected = pd.to_numeric(pd.Series(values).replace("0x1f", "z"), errors="coerce").notna()
    assert _flags(frame, is_number, values) == list(expected)


@pytest.mark.parametrize("digits", [1, 2, 3, 6])
def test_round_exact_is_python_round(frame, digits):
    rng = random.Random(7)
    values = [0.125, 0.375, 2.675, 1.005, 2.665, 81.755, 0.5, 1.5, -0.125, -2.675, 0.0, 100.0]
    values += [n / 1000 for n in range(-60, 60)] + [rng.uniform(-1e5, 1e5) for _ in range(300)]
    values += [n / d * 100 for d in range(1, 60) for n in range(0, d, 3)]
    rows = frame("v double", *values).select("v", round_exact(F.col("v"), digits)).collect()
    for value, got in rows:
        assert got == round(value, digits), value


def test_round_exact_up_on_ties(frame):
    rows = frame("v double", 0.25, 0.75, 0.15, 0.05, 2.5).select(round_exact(F.col("v"), 1, "up"))
    assert [row[0] for row in rows.collect()] == [0.3, 0.8, 0.1, 0.1, 2.5]


def test_large_values_stay(frame):
    rows = frame("v double", 1e300, -1e17).select(round_exact(F.col("v"), 6)).collect()
    assert [row[0] for row in rows] == [1e300, -1e17]


def test_formats(frame):
    rows = (
        frame("a double, b double", (10.0, 12.34), (5.0, 2.0), (None, None), (1.0, 1.01))
        .select(percent_text(F.col("b")), delta_text(F.col("a"), F.col("b")))
        .collect()
    )
    assert [tuple(row) for row in rows] == [
        ("12.3%", "+2.3%"),
        ("2.0%", "-3.0%"),
        ("0.0%", "0.0%"),
        ("1.0%", "0.0%"),
    ]


def test_file_stem(frame):
    rows = frame("v string", "/a/b/my file.csv", "x.tar.gz", "plain", ".hidden")
    assert [row[0] for row in rows.select(file_stem(F.col("v"))).collect()] == [
        "my file", "x.tar", "plain", ".hidden",
    ]
