import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import transformers as T
from palisade.operators import censor as C
from palisade.operators.matcher import PhraseMatcher, PhraseScanner
from palisade.sources.dataset import DataSet, terms_of
from palisade.sources.english import english_dataset, english_recommended_transformers
from palisade.streaming import moderate

DROP_SPACES = T.create_simple_transformer(lambda c: None if c == " " else c)
A_TO_B = T.create_simple_transformer(lambda c: "b" if c == "a" else c)


@pytest.mark.parametrize(("patterns", "white", "black_t", "white_t", "text", "want"), [
    (["WORLD"], [], [], [], "hello world", []), (["yO"], [], [], [], "hello yO yo", [(6, 7, 2)]), (["cool 🌉"], [], [], [], "cool cool cool cool 🌉", [(15, 21, 6)]),
    (["her"], [], [], [], "h he! her", [(6, 8, 3)]), (["\0"], [], [], [], "\0", [(0, 0, 1)]), (["ass"], [], [], [], "🤣ass", [(2, 4, 3)]),
    (["penis"], ["pen is"], [T.skip_non_alphabetic()], [], "the pen is mightier than the penis", [(29, 33, 5)]), (["bitch"], ["bit", "itch"], [], [], "a bitch", [(2, 6, 5)]),
    (["something"], [], [DROP_SPACES], [], "s o m e t h i n  g", [(0, 17, 9)]), (["hbllo?"], [], [A_TO_B], [], "sup hallothere", [(4, 9, 6)]),
    (["bbb"], ["aabbbaa"], [A_TO_B], [], "!!!! $$aabbbaa## !!!", []), (["world"], ["helloworld!"], [], [DROP_SPACES], "h e l l o world!", []), (["|no"], [], [], [], "yno", []),
    (["f?ck"], [], [], [], "f🌉ck", []), (["??"], [], [], [], "🌉", [(0, 1, 1)]),
])
def test_goldens(patterns, white, black_t, white_t, text, want):
    scanner = PhraseScanner(terms_of(patterns), white, black_t, white_t)
    assert sorted(m[1:] for m in scanner.scan(text)) == want
    assert bool(scanner.scan(text, stop=True)) == bool(want)


def test_preset_sentences():
    m = PhraseMatcher(**english_dataset().build(), **english_recommended_transformers()).scanner
    assert sorted(x[1:3] for x in m.scan("ʃ𝐟ʃὗƈｋ ỹоứ 𝔟ⁱẗ𝙘ɦ")) == [(0, 6), (12, 18)]
    for text in ("you are a little fucker", "fk you", "ffuk you", "i like a$$es"):
        assert m.scan(text)
    for text in ("the pen is mightier than the sword", "i love bananas so yeah", "this song seems really banal", "grapes are really yummy", '    "" ""\n    "" ""\nAssamese -> Assam'):
        assert not m.scan(text)
    assert len(m.rules) == 113  # of 118 different patterns five can never match


def test_construction_errors():
    two = terms_of(["a"]) * 2
    for args, part in (((two,), "Duplicate blacklisted term ID 0."), ((terms_of(["[a]"]),), "Pattern with ID 0 potentially matches empty"), ((terms_of(["a"]), [""]), "empty string")):
        with pytest.raises(ValueError, match=part):
            PhraseMatcher(*args)
    with pytest.raises(ValueError, match="non-negative"):
        T.collapse_duplicates(1, {"a": -1})
    with pytest.raises(ValueError, match="one code point"):
        T.remap_characters([("ab", "c")])


def test_transformers_agree_with_one_character_at_a_time():
    r = random.Random(5)
    chain = [T.remap_characters([("a", "xy"), ("b", "a")]), T.collapse_duplicates(1, {"a": 2, "l": 0, "e": float("inf")}), T.skip_non_alphabetic()]
    pipeline = T.Pipeline(chain)
    for _ in range(2000):
        text = "".join(r.choice("axyble 1é🌉") for _ in range(r.randint(0, 14)))
        out, last, run = [], None, 0
        for i, c in enumerate(text):
            c = {"x": "a", "y": "a", "a": "b"}.get(c, c)
            run = run + 1 if c == last else 1
            last = c
            if run <= {"a": 2, "l": 0, "e": 99}.get(c, 1) and c.isascii() and c.isalpha():
                out.append((c, i))
        assert pipeline.traced(text) == ("".join(c for c, _ in out), [i for _, i in out])
        assert pipeline.value(text) == "".join(c for c, _ in out)


def test_last_target_wins_and_fusion():
    assert T.remap_characters([("x", "a"), ("y", "a")]).table == {"a": "y"}
    assert T.fused([T.Remap({"a": "b"}), T.Remap({"b": "c"})])[0].table == {"a": "c", "b": "c"}


def _censored(spark, text, matches, strategy):
    df = spark.createDataFrame([(text, [{"term_id": t, "start_index": s, "end_index": e, "match_length": n} for t, s, e, n in matches] if matches is not None else None)], "t string, m array<struct<term_id:int,start_index:int,end_index:int,match_length:int>>")
    return df.select(C.TextCensor(strategy).apply_to(F.col("t"), F.col("m"))).first()[0]


def test_censor(spark):
    dots = C.fixed_char(".")
    assert _censored(spark, "thinking of good test data is hard", [(0, 0, 4, 5), (0, 0, 7, 8)], dots) == "............. of good test data is hard"
    assert _censored(spark, "tests", [(0, 1, 2, 2), (0, 2, 2, 1)], dots) == "t..ts"
    assert _censored(spark, "heretical", [(0, 1, 3, 3), (1, 1, 3, 3)], dots) == "h...tical"
    assert _censored(spark, "hello world!", [(0, 6, 10, 5)], C.keep_start(dots)) == "hello w....!"
    assert _censored(spark, "hello world!", [(0, 6, 10, 5)], C.keep_end(dots)) == "hello ....d!"
    assert _censored(spark, "a🌉b🌉", [(0, 1, 5, 3)], C.keep_end(dots)) == "a..🌉"
    assert _censored(spark, "abc", [], dots) == "abc" and _censored(spark, None, [], dots) is None and _censored(spark, "abc", None, dots) is None
    out = _censored(spark, "xxxxxxxx", [(0, 0, 7, 8)], None)
    assert len(out) == 8 and set(out) <= set(C.GRAWLIX) and all(a != b for a, b in zip(out, out[1:], strict=False))
    with pytest.raises(ValueError, match="at least 2"):
        C.random_char_from_set("a")


def test_columns_nulls_and_metadata(spark):
    data = DataSet().add_phrase(lambda p: p.set_metadata("bad").add_pattern("foo").add_pattern("b[a]r"))
    matcher = PhraseMatcher(**data.build())
    df = spark.createDataFrame([(1, "foo bar"), (2, ""), (3, None)], "id int, text string")
    assert {r[0]: r[1] for r in df.select("id", matcher.has_match(F.col("text"))).collect()} == {1: True, 2: False, 3: None}
    rows = data.with_metadata(matcher.all_matches(df, keep=["id"])).collect()
    assert sorted((r.term_id, r.phrase_metadata) for r in rows) == [(0, "bad"), (1, "bad")]
    with pytest.raises(Exception, match="The pattern with ID 9 does not exist"):
        data.with_metadata(spark.createDataFrame([(9,)], "term_id int")).collect()
    with pytest.raises(KeyError):
        data.phrase_metadata(2)
    assert len(data.add_all(data).build()["blacklisted_terms"]) == 4 and not data.remove_phrases_if(lambda p: True).phrases


def test_stream(spark, tmp_path):
    spark.createDataFrame([("this is foo",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    out = moderate(stream, PhraseMatcher(terms_of(["foo"])), C.TextCensor(C.asterisks()))
    query = out.writeStream.format("memory").queryName("moderated").start()
    query.processAllAvailable()
    query.stop()
    assert [r.censored for r in spark.table("moderated").collect()] == ["this is ***"]
