"""Phrase matching: spans of patterns in normalised text, less those inside allowed spans.

Offsets count UTF-16 units of the original text and the end is inclusive; ``match_length`` counts code points of the
normalised match. One Arrow function does a document at a time: it normalises with compiled tables, tests each pattern's
required text before running the pattern, and traces offsets only for documents in which a pattern fires.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.transformers import Collapse, Pipeline, PyTransform, Transformer, normalised
from ..plans.patterns import BlacklistedTerm, potentially_matches_empty_string, required_text, to_regex

MATCH = "struct<term_id:int,start_index:int,end_index:int,match_length:int>"
_MATCH = pa.struct([("term_id", pa.int32()), ("start_index", pa.int32()), ("end_index", pa.int32()), ("match_length", pa.int32())])


class Matcher(Protocol):
    """What queries need of a matcher: two columns over a text column."""

    def matches(self, text: Column, sorted: bool = False) -> Column: ...

    def has_match(self, text: Column) -> Column: ...


def _units(text: str) -> str:
    """The text with each astral character as its two surrogates, so that places are UTF-16 units."""
    if text.isascii() or max(text) < "\U00010000":
        return text
    return "".join(c if c < "\U00010000" else chr(0xD800 + ((ord(c) - 0x10000) >> 10)) + chr(0xDC00 + ((ord(c) - 0x10000) & 0x3FF)) for c in text)


def _trace(pipeline: Pipeline, text: str) -> tuple[str, list[int], list[int]]:
    """Normalised units, and for each the first and the last unit of its source character."""
    chars, places = pipeline.traced(text)
    starts, at = [], 0
    for c in text:
        starts.append(at)
        at += 1 + (c > "￿")
    first, last = [], []
    for c, p in zip(chars, places, strict=True):
        for _ in range(1 + (c > "￿")):
            first.append(starts[p])
            last.append(starts[p] + (text[p] > "￿"))
    return _units(chars), first, last


class PhraseScanner:
    """The matcher's work on one string; plain Python, sent to executors as it is."""

    def __init__(self, terms: Sequence[BlacklistedTerm], allowed: Sequence[str], black: Iterable[Transformer], white: Iterable[Transformer]):
        self.black, self.white, self.allowed = Pipeline(black), Pipeline(white), list(dict.fromkeys(map(_units, allowed)))
        by_rule: dict[str, list[int]] = {}
        required: dict[str, str] = {}
        for term in terms:
            rule = to_regex(term.pattern, "python")
            by_rule.setdefault(_units(rule), []).append(term.id)  # equal patterns are scanned once
            required[_units(rule)] = _units(required_text(term.pattern))
        self.rules = [(required[r], re.compile(r), ids) for r, ids in by_rule.items() if self._can_fire(required[r])]

    def _can_fire(self, text: str) -> bool:
        """False if the last step collapses runs and the text has a run that it never leaves."""
        last = self.black.chain[-1:]
        return not (last and isinstance(last[0], Collapse) and Pipeline(last).value(text) != text)

    def _intervals(self, text: str) -> list[tuple[int, int]]:
        value = _units(self.white.value(text))
        hits = [w for w in self.allowed if w in value]
        if not hits:
            return []
        units, first, last = _trace(self.white, text)
        out = []
        for w in hits:
            at = units.find(w)
            while at >= 0:
                out.append((first[at], last[at + len(w) - 1]))
                at = units.find(w, at + len(w))
        return sorted(out)

    def scan(self, text: str, stop: bool = False) -> list[tuple[int, int, int, int]]:
        """(term_id, start, end, length) of all matches, or of the first one found."""
        value = _units(self.black.value(text))
        firing = [(rule, ids) for need, rule, ids in self.rules if need in value and rule.search(value)]
        if not firing:
            return []
        units, first, last = _trace(self.black, text)
        shut = self._intervals(text)
        out = []
        for rule, ids in firing:
            for m in rule.finditer(units):
                s, e = m.span()
                start, end = first[s], last[e - 1]
                if any(lo <= start and end <= hi for lo, hi in shut):
                    continue
                length = e - s - sum("\udc00" <= c <= "\udfff" for c in units[s + 1 : e])
                out += [(i, start, end, length) for i in ids]
                if stop:
                    return out
        return out


class PhraseMatcher:
    """Finds blacklisted patterns that no whitelisted text covers."""

    def __init__(self, blacklisted_terms: Sequence[BlacklistedTerm], whitelisted_terms: Sequence[str] = (), blacklist_matcher_transformers: Sequence[Transformer] = (), whitelist_matcher_transformers: Sequence[Transformer] = ()):
        seen = set()
        for term in blacklisted_terms:
            if term.id in seen:
                raise ValueError(f"Duplicate blacklisted term ID {term.id}.")
            if potentially_matches_empty_string(term.pattern):
                raise ValueError(f"Pattern with ID {term.id} potentially matches empty string; this is unsupported.")
            seen.add(term.id)
        if "" in whitelisted_terms:
            raise ValueError("Whitelisted term set contains empty string; this is unsupported.")
        self.terms, self.black = list(blacklisted_terms), list(blacklist_matcher_transformers)
        self.scanner = PhraseScanner(blacklisted_terms, whitelisted_terms, blacklist_matcher_transformers, whitelist_matcher_transformers)
        self.plain = not whitelisted_terms and not any(isinstance(t, PyTransform) for t in self.black)

    def matches(self, text: Column, sorted: bool = False) -> Column:  # noqa: A002
        """An array of matches; null for null texts. Sorted by start, end and term id on request."""
        scanner = self.scanner

        @F.arrow_udf(f"array<{MATCH}>")
        def scan(texts: pa.Array) -> pa.Array:
            rows = []
            for t in texts.to_pylist():
                found = None if t is None else scanner.scan(t)
                if found and sorted:
                    found.sort(key=lambda m: (m[1], m[2], m[0]))
                rows.append(found and [dict(zip(("term_id", "start_index", "end_index", "match_length"), m, strict=True)) for m in found])
            return pa.array(rows, pa.list_(_MATCH))

        return scan(text)

    def has_match(self, text: Column) -> Column:
        """Whether there is a match; null for null texts. A single plain pattern is tested by built-in functions."""
        if self.plain and len(self.terms) == 1 and "[\\x{0}" not in (rule := to_regex(self.terms[0].pattern)):
            return normalised(text, self.black).rlike(rule)
        scanner = self.scanner

        @F.arrow_udf("boolean")
        def test(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else bool(scanner.scan(t, stop=True)) for t in texts.to_pylist()], pa.bool_())

        return test(text)

    def whitelist_intervals(self, text: Column) -> Column:
        """The allowed spans, as an array of (lo, hi)."""
        scanner = self.scanner

        @F.arrow_udf("array<struct<lo:int,hi:int>>")
        def scan(texts: pa.Array) -> pa.Array:
            kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
            return pa.array([None if t is None else [{"lo": a, "hi": b} for a, b in scanner._intervals(t)] for t in texts.to_pylist()], kind)

        return scan(text)

    def all_matches(self, df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
        """A row per match, with the columns ``keep`` of its document; nothing is shuffled."""
        found = df.select(*keep, F.explode(self.matches(F.col(text))).alias("_m"))
        return found.select(*keep, "_m.*")

    def filter(self, df: DataFrame, text: str = "text") -> DataFrame:
        """The documents with a match."""
        return df.where(self.has_match(F.col(text)))


def contained(intervals: Column, lo: Column, hi: Column) -> Column:
    """Whether a single one of the intervals (an array of (lo, hi)) contains [lo, hi]."""
    return F.exists(intervals, lambda w: (w["lo"] <= lo) & (hi <= w["hi"]))


def sorted_matches(matches: Column) -> Column:
    """An array of matches by start, end and term id."""
    order = F.array_sort(F.transform(matches, lambda m: F.struct(m["start_index"].alias("start_index"), m["end_index"].alias("end_index"), m["term_id"].alias("term_id"), m["match_length"].alias("match_length"))))
    return F.transform(order, lambda m: F.struct(m["term_id"].alias("term_id"), m["start_index"].alias("start_index"), m["end_index"].alias("end_index"), m["match_length"].alias("match_length")))
