from pyspark.sql import functions as F

from palisade.functions import characters as ch
from palisade.functions import transformers as T
from palisade.operators.intervals import IntervalCollection
from palisade.sources.english import english_dataset, english_profane_words


def test_characters(spark):
    rows = spark.createDataFrame([("a🌉b\n🌉",), ("",), (None,), ("Zé",)], "t string").select(ch.characters(F.col("t")).alias("c")).collect()
    assert [None if r.c is None else [tuple(x) for x in r.c] for r in rows] == [[(97, 0, 1), (0x1F309, 1, 2), (98, 3, 1), (10, 4, 1), (0x1F309, 5, 2)], [], None, [(90, 0, 1), (233, 1, 1)]]


def test_predicates(spark):
    row = spark.range(1).select(
        ch.code_point_of_pair(F.lit(0xD83C), F.lit(0xDF09)).alias("pair"), ch.is_high_surrogate(F.lit(0xD83C)).alias("high"), ch.is_low_surrogate(F.lit(0xD83C)).alias("low"),
        ch.invert_case(F.lit(ord("a"))).alias("flip"), ch.is_word_char(F.lit(ord("_"))).alias("word"), ch.is_alphabetic(F.lit(ord("Q"))).alias("letter"),
    ).first()
    assert tuple(row) == (0x1F309, True, False, ord("A"), False, True)


def test_intervals():
    spans = IntervalCollection()
    assert not spans.query(0, 0)
    for lo, hi in ((5, 9), (1, 3), (2, 20), (8, 8)):
        spans.insert(lo, hi)
    assert spans.query(3, 20) and spans.query(1, 3) and spans.query(8, 8) and not spans.query(1, 4) and not spans.query(3, 21) and not spans.query(0, 2)
    assert sorted(spans) == sorted(spans.values()) == [(1, 3), (2, 20), (5, 9), (8, 8)]


def test_kinds_of_transformers():
    kinds = [T.transformer_type(t) for t in (T.to_ascii_lower_case(), T.collapse_duplicates(), T.create_simple_transformer(str.lower), T.create_stateful_transformer(lambda: str.lower))]
    assert kinds == [T.TransformerType.Simple, T.TransformerType.Stateful, T.TransformerType.Simple, T.TransformerType.Stateful]


def test_words_of_the_preset():
    assert len(english_profane_words()) == 69 and {p.metadata for p in english_dataset().phrases} == set(english_profane_words())
