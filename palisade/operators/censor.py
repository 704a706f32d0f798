"""Censoring: rewrites matched spans by a strategy, one row at a time, in built-in functions only.

Matches are taken in order of start, end and term id. What an earlier match has covered is not written again; a match
wholly inside is skipped. Places are UTF-16 units, so text is cut in UTF-16.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matcher import sorted_matches


@dataclass(frozen=True)
class CensorContext:
    """Columns of one match; ``utf16`` is the whole text in UTF-16."""

    text: Column
    utf16: Column
    term_id: Column
    start_index: Column
    end_index: Column
    match_length: Column
    overlaps_at_start: Column
    overlaps_at_end: Column

    def replaced(self, **columns: Column) -> CensorContext:
        return CensorContext(**{**self.__dict__, **columns})


Strategy = Callable[[CensorContext], Column]
GRAWLIX = "%@$&*"


def _cut(utf16: Column, start: Column, length: Column | None = None) -> Column:
    n = F.lit(1 << 28) if length is None else length
    return F.decode(F.substring(utf16, start * 2 + 1, n * 2), "UTF-16BE")


def fixed_phrase(phrase: str) -> Strategy:
    return lambda c: F.lit(phrase)


def fixed_char(char: str) -> Strategy:
    """The character as often as the match is long; a length below 1 gives nothing."""
    if len(char) != 1:
        raise ValueError("Expected the input string to be one code point in length.")
    return lambda c: F.repeat(F.lit(char), c.match_length)


def asterisks() -> Strategy:
    return fixed_char("*")


def random_char_from_set(charset: str) -> Strategy:
    """Characters of the set, never the same place of the set twice in a row; drawn from a hash of text and span."""
    if len(charset) < 2:
        raise ValueError("The character set passed must have at least 2 characters.")
    k, table = len(charset), F.array(*map(F.lit, charset))

    def write(c: CensorContext) -> Column:
        def step(a: Column, i: Column) -> Column:
            draw = F.xxhash64(c.text, c.start_index, c.end_index, i)
            at = F.when(a["at"] < 0, F.pmod(draw, F.lit(k))).otherwise((a["at"] + 1 + F.pmod(draw, F.lit(k - 1))) % k)
            return F.struct(at.cast("long").alias("at"), F.concat(a["out"], F.get(table, at.cast("int"))).alias("out"))

        start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit("").alias("out"))
        return F.when(c.match_length < 1, F.lit("")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), c.match_length)), start, step, lambda a: a["out"]))

    return write


def grawlix() -> Strategy:
    return random_char_from_set(GRAWLIX)


def keep_start(base: Strategy) -> Strategy:
    """The first code point, then the base strategy for the rest; only the base where an earlier match overlaps."""

    def write(c: CensorContext) -> Column:
        first = F.substring(_cut(c.utf16, c.start_index, F.lit(2)), 1, 1)
        return F.when(c.overlaps_at_start, base(c)).otherwise(F.concat(first, base(c.replaced(match_length=c.match_length - 1))))

    return write


def keep_end(base: Strategy) -> Strategy:
    """The base strategy, then the whole last code point; only the base where a later match overlaps."""

    def write(c: CensorContext) -> Column:
        low = F.greatest(F.lit(0), c.end_index - 1)
        last = F.substring(_cut(c.utf16, low, c.end_index - low + 1), -1, 1)
        return F.when(c.overlaps_at_end, base(c)).otherwise(F.concat(base(c.replaced(match_length=c.match_length - 1)), last))

    return write


class TextCensor:
    """Applies a strategy to matched texts; grawlix unless another is set."""

    def __init__(self, strategy: Strategy | None = None):
        self.strategy = strategy or grawlix()

    def set_strategy(self, strategy: Strategy) -> TextCensor:
        return TextCensor(strategy)

    def apply_to(self, text: Column, matches: Column) -> Column:
        """The censored text; null if either is null, unchanged without matches."""
        order = sorted_matches(matches)
        none = F.array(F.lit(None).cast("struct<term_id:int,start_index:int,end_index:int,match_length:int>"))
        later = F.concat(F.slice(order, F.lit(2), F.greatest(F.lit(0), F.size(order) - 1)), none)
        # where the text is written up to before each match, and at last: only these numbers are carried along
        reach = F.aggregate(order, F.array(F.lit(0)), lambda a, m: F.concat(a, F.array(F.greatest(F.element_at(a, -1), m["end_index"] + 1))))

        def rewrite(b: Column) -> Column:
            def piece(x: Column) -> Column:
                m, n, prev = x["m"], x["n"], x["prev"]
                ahead = F.coalesce((n["start_index"] <= m["end_index"]) & (m["end_index"] < n["end_index"]), F.lit(False))
                over = m["start_index"] < prev
                context = CensorContext(b["text"], b["utf16"], m["term_id"], F.greatest(prev, m["start_index"]), m["end_index"], m["match_length"], over, ahead)
                gap = F.when(over, F.lit("")).otherwise(_cut(b["utf16"], prev, m["start_index"] - prev))
                return F.when(prev > m["end_index"], F.lit("")).otherwise(F.concat(gap, self.strategy(context)))

            pairs = F.zip_with(b["order"], b["later"], lambda m, n: F.struct(m.alias("m"), n.alias("n")))
            steps = F.zip_with(pairs, F.slice(b["reach"], 1, F.size(b["order"])), lambda x, prev: F.struct(x["m"].alias("m"), x["n"].alias("n"), prev.alias("prev")))
            return F.concat(F.array_join(F.transform(steps, piece), ""), _cut(b["utf16"], F.element_at(b["reach"], -1)))

        # an array of one struct: what the steps look into is computed once per text
        bound = F.array(F.struct(text.alias("text"), F.encode(text, "UTF-16BE").alias("utf16"), order.alias("order"), later.alias("later"), reach.alias("reach")))
        return F.when(F.size(matches) > 0, F.get(F.transform(bound, rewrite), F.lit(0))).otherwise(F.when(matches.isNotNull(), text))
