import re

import pytest

from palisade.plans.patterns import Literal, Optional, ParserError, Wildcard, assign_incrementing_ids, pattern, potentially_matches_empty_string, to_regex


def test_parses():
    p = pattern(r"|a\[b[c\]]?[?]|")
    assert p.nodes == (Literal("a[b"), Optional(Literal("c]")), Wildcard(), Optional(Wildcard()))
    assert p.require_word_boundary_at_start and p.require_word_boundary_at_end
    assert pattern("|").require_word_boundary_at_start and not pattern("|").nodes
    assert not pattern("").nodes


@pytest.mark.parametrize(("source", "place", "part"), [
    ("su|p", (1, 3), "Boundary"), ("[|]", (1, 2), "Boundary"), ("[[a]]", (1, 2), "nested"), ("[a[b]]", (1, 3), "unclosed"), ("[??]", (1, 3), "unclosed"),
    ("[]", (1, 2), "Unexpected ']'"), ("[", (1, 1), "unclosed"), ("[aa", (1, 3), "unclosed"), ("[bar]]", (1, 6), "Unexpected ']'"), ("oopsies \\:", (1, 10), "Cannot escape character ':'"),
    ("hello foo\\", (1, 10), "trailing"), ("hello\\\n", (1, 7), "Cannot escape"), ("a\n🌉]", (2, 2), "Unexpected ']'"),
])
def test_errors(source, place, part):
    with pytest.raises(ParserError, match=re.escape(part)) as e:
        pattern(source)
    assert (e.value.line, e.value.column) == place and str(e.value).startswith(f"{place[0]}:{place[1]}: ")


def test_guard_and_ids():
    assert potentially_matches_empty_string(pattern("[a][?]")) and potentially_matches_empty_string(pattern("|"))
    assert not potentially_matches_empty_string(pattern("[a]b"))
    assert [t.id for t in assign_incrementing_ids([pattern("a"), pattern("b")])] == [0, 1]


def test_regex_boundaries_are_ascii():
    rule = re.compile(to_regex(pattern("|ass"), "python"))
    assert rule.search("éass") and not rule.search("_ass") and not rule.search("1ass")
    assert re.fullmatch(to_regex(pattern("a.?"), "python"), "a.\n")
