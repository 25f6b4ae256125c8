"""Size bounds of what is broadcast or held by a task.  They do not change results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # Vector components, and words, of a question batch held by every task.
    question_values: int = 2_000_000
    question_terms: int = 20_000
    # Histogram buckets per searched interval in the order-statistic passes.
    buckets: int = 2_048


DEFAULT_LIMITS = Limits()
