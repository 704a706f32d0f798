"""Characters of a text as columns: code points with their places in UTF-16, and tests on code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGH, LOW = (0xD800, 0xDBFF), (0xDC00, 0xDFFF)


def is_high_surrogate(code: Column) -> Column:
    return code.between(*HIGH)


def is_low_surrogate(code: Column) -> Column:
    return code.between(*LOW)


def code_point_of_pair(high: Column, low: Column) -> Column:
    return (high - HIGH[0]) * 0x400 + low - LOW[0] + 0x10000


def is_digit(code: Column) -> Column:
    return code.between(ord("0"), ord("9"))


def is_lower_case(code: Column) -> Column:
    return code.between(ord("a"), ord("z"))


def is_upper_case(code: Column) -> Column:
    return code.between(ord("A"), ord("Z"))


def is_alphabetic(code: Column) -> Column:
    return is_lower_case(code) | is_upper_case(code)


def is_word_char(code: Column) -> Column:
    return is_digit(code) | is_alphabetic(code)


def invert_case(code: Column) -> Column:
    """The other case of an ASCII letter."""
    return code.bitwiseXOR(F.lit(0x20))


def characters(text: Column) -> Column:
    """An array of (code_point, position, width): position and width count UTF-16 units. Null for null texts."""
    codes = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.ascii)
    width = lambda c: F.when(c > 0xFFFF, 2).otherwise(1)

    def place(codes: Column) -> Column:
        # places of texts without astral characters are their indexes; else the characters before are counted
        flat = F.transform(codes, lambda c, i: F.struct(c.alias("code_point"), i.alias("position"), F.lit(1).alias("width")))
        astral = F.filter(F.transform(codes, lambda c, i: F.when(c > 0xFFFF, i)), lambda i: i.isNotNull())
        deep = F.transform(codes, lambda c, i: F.struct(c.alias("code_point"), (i + F.size(F.filter(astral, lambda a: a < i))).alias("position"), width(c).alias("width")))
        return F.when(F.exists(codes, lambda c: c > 0xFFFF), deep).otherwise(flat)

    return F.get(F.transform(F.array(codes), place), F.lit(0))
