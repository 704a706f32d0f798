"""Spans on the driver, asked whether one of them holds a given span; the column form is ``matcher.contained``."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate


class IntervalCollection:
    """Inclusive spans. A span holds another if it starts no later and ends no earlier."""

    def __init__(self) -> None:
        self._spans: list[tuple[int, int]] = []
        self._reach: list[int] | None = None

    def insert(self, lo: int, hi: int) -> None:
        self._spans.append((lo, hi))
        self._reach = None

    def query(self, lo: int, hi: int) -> bool:
        if self._reach is None:  # how far the spans up to each one reach, in the order of their starts
            self._spans.sort()
            self._reach = list(accumulate((end for _, end in self._spans), max))
        k = bisect_right(self._spans, (lo, float("inf")))
        return k > 0 and self._reach[k - 1] >= hi

    def values(self) -> list[tuple[int, int]]:
        return list(self._spans)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return iter(self._spans)
