"""Text predicates: missing markers and numeric literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that counts as a missing cell, compared after strip and lower-case.
MISSING_TOKENS = ("", "na", "n/a", "nan", "null", "none", "missing", "unknown", "-", "--")

# Words that a delimited file uses for an absent value.
FILE_NULL_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Fixed value: what parses as a number (no type suffix, no digit separator, no "nan").
NUMBER_PATTERN = (
    r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
)

# All white space in Unicode, with the four ASCII separators \x1c-\x1f.
_SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"


def _any_case(token: str) -> str:
    # The Kelvin sign is the only non-ASCII character whose lower case is an ASCII letter.
    return re.escape(token).replace("k", r"[k\x{212A}]")


# One anchored match per cell: it fails on the first letters of ordinary text, however
# long, and builds no trimmed or lower-cased copy.
MISSING_PATTERN = (
    rf"(?i)\A{_SPACE}*(?:{'|'.join(_any_case(token) for token in MISSING_TOKENS)}){_SPACE}*\z"
)


def is_missing_token(text: Column) -> Column:
    return text.rlike(MISSING_PATTERN)


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER_PATTERN)
