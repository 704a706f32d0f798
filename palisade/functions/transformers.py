"""Character transformers: specifications that are composed at plan time.

A chain of transformers runs in three forms: as a Spark column (values only, built-in functions), over Python strings
(values only, compiled), and over Python strings with the source place of every kept character. All work in UTF-16
units where places are reported, so that offsets are those of UTF-16 text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from .confusables import confusables

# Leet-speak sources by target.
LEET = (("a", "@4"), ("c", "("), ("e", "3"), ("g", "6"), ("i", "1|!"), ("l", "/"), ("o", "0"), ("s", "$5"), ("t", "7"), ("z", "2"))


def single_code_point(text: str) -> str:
    if len(text) != 1:
        raise ValueError("Expected the input string to be one code point in length.")
    return text


@dataclass(frozen=True)
class Remap:
    """Replaces characters one by one; stateless."""

    table: Mapping[str, str]


@dataclass(frozen=True)
class Keep:
    """Drops every character outside a regular expression's character class."""

    chars: str


@dataclass(frozen=True)
class Collapse:
    """Keeps at most a threshold of each run of one character; thresholds may be 0 or infinite."""

    default: float = 1
    custom: Mapping[str, float] = field(default_factory=dict)

    def limit(self, c: str) -> float:
        return self.custom.get(c, self.default)


@dataclass(frozen=True)
class PyTransform:
    """A function from character to character, or None to drop it; ``factory`` makes one with its own state per text."""

    factory: Callable[[], Callable[[str], str | None]]
    stateful: bool = True


Transformer = Remap | Keep | Collapse | PyTransform


class TransformerType(IntEnum):
    """Whether a transformer looks at one character at a time or remembers what came before in its text."""

    Simple = 0
    Stateful = 1


def transformer_type(t: Transformer) -> TransformerType:
    return TransformerType.Stateful if isinstance(t, Collapse) or (isinstance(t, PyTransform) and t.stateful) else TransformerType.Simple


def create_simple_transformer(function: Callable[[str], str | None]) -> PyTransform:
    return PyTransform(lambda: function, stateful=False)


def create_stateful_transformer(factory: Callable[[], Callable[[str], str | None]]) -> PyTransform:
    """``factory`` is called for each text, so no state passes from one text to the next."""
    return PyTransform(factory)


def remap_characters(mapping: Mapping[str, str] | Iterable[tuple[str, str]]) -> Remap:
    """From target to source characters; of two targets for one source the later counts."""
    pairs = mapping.items() if isinstance(mapping, Mapping) else mapping
    return Remap({s: single_code_point(t) for t, sources in pairs for s in sources})


def resolve_confusables(table: Iterable[tuple[str, str]] | None = None) -> Remap:
    return remap_characters(table if table is not None else confusables())


def resolve_leet_speak() -> Remap:
    return remap_characters(LEET)


def to_ascii_lower_case() -> Remap:
    return Remap({chr(c): chr(c + 32) for c in range(65, 91)})


def skip_non_alphabetic() -> Keep:
    return Keep("A-Za-z")


def collapse_duplicates(default_threshold: float = 1, custom_thresholds: Mapping[str, float] | None = None) -> Collapse:
    custom = dict(custom_thresholds or {})
    for c, n in custom.items():
        if n < 0:
            raise ValueError("Expected all thresholds to be non-negative.")
        single_code_point(c)
    return Collapse(default_threshold, custom)


def fused(chain: Iterable[Transformer]) -> list[Transformer]:
    """Adjacent remaps as one."""
    out: list[Transformer] = []
    for t in chain:
        if isinstance(t, Remap) and out and isinstance(out[-1], Remap):
            first = out.pop().table
            table = {c: t.table.get(x, x) for c, x in first.items()} | {c: x for c, x in t.table.items() if c not in first}
            t = Remap(table)
        if isinstance(t, Remap):
            t = Remap({c: x for c, x in t.table.items() if c != x})
        out.append(t)
    return out


def _class(chars: Iterable[str]) -> str:
    return "".join("\\" + c if c in "\\]^-[&" else c for c in sorted(chars))


def _collapse_steps(t: Collapse) -> list[tuple[str, int]]:
    """(character class, threshold) for each finite threshold; the class of the default one excludes the others'."""
    limits: dict[float, list[str]] = {}
    for c, n in t.custom.items():
        limits.setdefault(n, []).append(c)
    steps = [(f"[{_class(cs)}]", n) for n, cs in limits.items()]
    steps.append((f"[^{_class(t.custom)}]" if t.custom else "[\\s\\S]", t.default))
    found = [(c, max(0, math.ceil(n))) for c, n in steps if not math.isinf(n)]
    return sorted(found, key=lambda x: x[1] == 0)  # what is dropped still parts the runs beside it


def normalised(text: Column, chain: Iterable[Transformer]) -> Column:
    """The transformed text by built-in functions; not for Python transformers."""
    for t in fused(chain):
        if isinstance(t, Remap):
            if t.table:
                text = F.translate(text, "".join(t.table), "".join(t.table.values()))
        elif isinstance(t, Keep):
            text = F.regexp_replace(text, F.lit(f"[^{t.chars}]"), F.lit(""))
        elif isinstance(t, Collapse):
            for chars, n in _collapse_steps(t):
                rule = f"(?s)({chars})\\1{{{n},}}" if n else f"(?s){chars}"
                text = F.regexp_replace(text, F.lit(rule), F.lit("$1" * n))
        else:
            raise TypeError("a Python transformer has no built-in form")
    return text


class Pipeline:
    """A chain compiled for Python strings."""

    def __init__(self, chain: Iterable[Transformer]):
        self.chain = fused(chain)
        self._steps = [self._compiled(t) for t in self.chain]

    @staticmethod
    def _compiled(t: Transformer) -> Callable[[str], str]:
        if isinstance(t, Remap):
            table = str.maketrans(dict(t.table))
            return lambda s: s.translate(table)
        if isinstance(t, Keep):
            return lambda s, drop=re.compile(f"[^{t.chars}]+"): drop.sub("", s)
        if isinstance(t, Collapse):
            rules = [(re.compile(f"({c})\\1{{{n},}}" if n else c), n) for c, n in _collapse_steps(t)]

            def collapse(s: str) -> str:
                for rule, n in rules:
                    s = rule.sub((lambda m, n=n: m[1] * n) if n else "", s)
                return s

            return collapse

        def own(s: str) -> str:
            step = t.factory()
            return "".join(x for c in s if (x := step(c)) is not None)

        return own

    def value(self, text: str) -> str:
        for step in self._steps:
            text = step(text)
        return text

    def traced(self, text: str) -> tuple[str, list[int]]:
        """The transformed text and the place of each of its characters in ``text``."""
        chars, places = list(text), list(range(len(text)))
        for t in self.chain:
            if isinstance(t, Remap):
                chars = [t.table.get(c, c) for c in chars]
                continue
            if isinstance(t, Keep):
                keep = re.compile(f"[{t.chars}]").fullmatch
                kept = [(c, p) for c, p in zip(chars, places, strict=True) if keep(c)]
            elif isinstance(t, Collapse):
                kept, last, run = [], None, 0
                for c, p in zip(chars, places, strict=True):
                    run = run + 1 if c == last else 1
                    last = c
                    if run <= math.ceil(t.limit(c)) if not math.isinf(t.limit(c)) else True:
                        kept.append((c, p))
            else:
                step = t.factory()
                kept = [(x, p) for c, p in zip(chars, places, strict=True) if (x := step(c)) is not None]
            chars, places = [c for c, _ in kept], [p for _, p in kept]
        return "".join(chars), places
