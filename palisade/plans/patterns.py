"""The pattern language: literals, ``[optional]`` parts, ``?`` wildcards and ``|`` word boundaries at either end.

A backslash takes away the meaning of ``\\ [ ] ? |``. Patterns are parsed on the driver, once, into small frozen trees
that are then written as regular expressions for Spark (Java), Python and RE2.
"""

from __future__ import annotations

import enum
from collections.abc import Iterable, Iterator
from dataclasses import dataclass


class SyntaxKind(enum.IntEnum):
    Optional = 0
    Wildcard = 1
    Literal = 2
    BoundaryAssertion = 3


class ParserError(ValueError):
    """A pattern that cannot be parsed; line and column count from 1, in code points."""

    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"{line}:{column}: {message}")
        self.line, self.column = line, column


@dataclass(frozen=True)
class Literal:
    text: str
    kind = SyntaxKind.Literal


@dataclass(frozen=True)
class Wildcard:
    kind = SyntaxKind.Wildcard


@dataclass(frozen=True)
class Optional:
    child: Literal | Wildcard
    kind = SyntaxKind.Optional


@dataclass(frozen=True)
class ParsedPattern:
    nodes: tuple[Literal | Wildcard | Optional, ...] = ()
    require_word_boundary_at_start: bool = False
    require_word_boundary_at_end: bool = False


@dataclass(frozen=True)
class BlacklistedTerm:
    id: int
    pattern: ParsedPattern


# What can be escaped, and the messages.
ESCAPABLE = "\\[]?|"
_ESCAPE = "Cannot escape character '{}'; the only characters that can be escaped are the following: '\\', '[', ']', '?', '|'."
_BOUNDARY = "Boundary assertions are not supported in this position; they are only allowed at the start / end of the pattern."
_UNCLOSED = "Unexpected unclosed '['."
_NESTED = "Unexpected nested optional node."
_STRAY = "Unexpected ']' with no corresponding '['."
_TRAILING = "Unexpected trailing backslash."


@dataclass(frozen=True)
class _Token:
    mark: str  # one of "[]?|", or "" for a literal
    text: str
    at: tuple[int, int]


def _positions(source: str) -> Iterator[tuple[str, tuple[int, int]]]:
    line, column = 1, 1
    for c in source:
        yield c, (line, column)
        line, column = (line + 1, 1) if c == "\n" else (line, column + 1)


def _tokens(source: str) -> Iterator[_Token]:
    """Marks and literals; lazily, so that the error furthest to the left is the one reported."""
    text, start, slash = "", None, None
    for c, at in _positions(source):
        if slash:
            if c not in ESCAPABLE:
                raise ParserError(_ESCAPE.format(c), *at)
            text, slash = text + c, None
        elif c in "[]?|":
            if start:
                yield _Token("", text, start)
                text, start = "", None
            yield _Token(c, c, at)
        else:
            start = start or at
            if c == "\\":
                slash = at
            else:
                text += c
    if slash:
        raise ParserError(_TRAILING, *slash)
    if start:
        yield _Token("", text, start)


def pattern(source: str) -> ParsedPattern:
    """Parses a pattern; use raw strings for those with backslashes."""
    nodes, at_start, at_end = [], False, False
    tokens, pending, first = _tokens(source), None, True
    last = [at for _, at in _positions(source)][-1:] or [(1, 1)]
    while (token := next(tokens, None)) is not None:
        if pending:
            raise ParserError(_BOUNDARY, *pending)
        if token.mark == "|":
            if first:
                at_start = True
            else:
                pending, at_end = token.at, True
        elif token.mark == "]":
            raise ParserError(_STRAY, *token.at)
        elif token.mark == "[":
            inner = next(tokens, None)
            if inner is None:
                raise ParserError(_UNCLOSED, *token.at)
            if inner.mark in ("[", "|", "]") and inner.mark:
                raise ParserError({"[": _NESTED, "|": _BOUNDARY, "]": _STRAY}[inner.mark], *inner.at)
            close = next(tokens, None)
            if close is None or close.mark != "]":
                raise ParserError(_UNCLOSED, *(close.at if close else last[0]))
            nodes.append(Optional(Wildcard() if inner.mark else Literal(inner.text)))
        else:
            nodes.append(Wildcard() if token.mark else Literal(token.text))
        first = False
    return ParsedPattern(tuple(nodes), at_start, at_end)


parse_raw_pattern = pattern


def assign_incrementing_ids(patterns: Iterable[ParsedPattern]) -> list[BlacklistedTerm]:
    return [BlacklistedTerm(i, p) for i, p in enumerate(patterns)]


def potentially_matches_empty_string(p: ParsedPattern) -> bool:
    return all(isinstance(n, Optional) for n in p.nodes)


_SPECIAL = frozenset("[.*+?^${}()|\\]")
_WORD = "[0-9A-Za-z_]"


def escaped(text: str) -> str:
    """Escapes what Java, RE2 and Python all treat as special, and nothing else."""
    return "".join("\\" + c if c in _SPECIAL else c for c in text)


def _edge(pattern_: ParsedPattern, last: bool) -> str | None:
    """The literal character that always stands at an edge of a match, if there is one."""
    nodes = pattern_.nodes[::-1] if last else pattern_.nodes
    node = nodes[0] if nodes else None
    return (node.text[-1] if last else node.text[0]) if isinstance(node, Literal) else None


def to_regex(p: ParsedPattern, dialect: str = "java") -> str:
    """The pattern as a regular expression for ``java``, ``python`` or ``re2``.

    Boundaries are those of ASCII words. Next to a literal word character one look-around is enough; RE2 has none, but
    its own boundary is ASCII.
    """
    one = {"java": r"[\x{0}-\x{FFFF}]", "re2": r"[\x{0}-\x{FFFF}]", "python": "[\\x00-\\uffff]"}[dialect]

    def write(node) -> str:
        if isinstance(node, Literal):
            return escaped(node.text)
        return one if isinstance(node, Wildcard) else f"(?:{write(node.child)})?"

    def boundary(last: bool) -> str:
        if dialect == "re2":
            return r"\b"
        c = _edge(p, last)
        if c and c.isascii() and (c.isalnum() or c == "_"):
            return f"(?!{_WORD})" if last else f"(?<!{_WORD})"
        return f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

    start = boundary(False) if p.require_word_boundary_at_start else ""
    end = boundary(True) if p.require_word_boundary_at_end else ""
    return f"(?s){start}{''.join(map(write, p.nodes))}{end}"


def required_text(p: ParsedPattern) -> str:
    """The longest literal that stands in every match; empty if there is none."""
    return max((n.text for n in p.nodes if isinstance(n, Literal)), key=len, default="")
