"""Quality rules in DataFrame functions only: counts, and divergence from language references.

A document's histograms of character classes and of common words are compared with references by Jensen-Shannon
distance. The reference of a language is the mean normalised histogram of all its documents that pass the count
rules and are long enough; documents of languages too rare for one are compared with the mean over all languages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, materialize

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:'\"?!()-"
CLASSES = ("lower", "upper", "digit", "mark", "symbol", "other")
#: Frequent function words of English, French, German and Spanish; what is not listed counts as one further word.
COMMON = (
    "the of and to in is that it was for on are with as by be this from or an "
    "la le les des et un une dans est pour que qui du au par "
    "der die das und den von mit ist nicht ein eine auf für sich "
    "el los las en por con una del para es se"
).split()
_POS = 21
_CODE = 64


def _with_repeated_words(df: DataFrame, bits: int = _POS) -> DataFrame:
    """Adds ``n_repeat_words``, the words inside any 3-word window found twice or more, by sorting each text's windows.

    Needs ``words`` and ``n``. A window's hash is packed with its place, of ``bits`` bits, into one number, so that equal
    windows become neighbours, which are compared word by word. Where neighbours of one hash differ, or places don't fit,
    the windows themselves are sorted, so that the count is exact whatever the hashes. Every array that a lambda looks
    into is a column of its own, so that it is computed once.
    """
    word = lambda i, k: F.get("words", i + k)
    same = lambda i, j: reduce(lambda a, b: a & b, [word(i, k) == word(j, k) for k in range(3)])
    low, n, places = F.lit((1 << bits) - 1).cast("long"), F.col("n"), F.sequence(F.lit(0), F.col("n") - 3)
    df = df.withColumn("hashes", F.when(n >= 3, F.transform(places, lambda i: F.xxhash64(word(i, 0), word(i, 1), word(i, 2)))))
    # most texts repeat no window: only the others sort theirs
    df = df.withColumn("again", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    packed = F.transform("hashes", lambda h, i: F.shiftleft(h, bits).bitwiseOR(i.cast("long")))
    df = df.withColumn("packed", F.when(F.col("again") & (n <= 1 << bits), F.sort_array(packed)))
    key, place = lambda x: F.shiftright(x, bits), lambda x: x.bitwiseAND(low).cast("int")
    at = lambda i: F.get("packed", i)
    differ = F.exists(F.sequence(F.lit(1), F.size("packed") - 1), lambda i: (key(at(i - 1)) == key(at(i))) & ~same(place(at(i - 1)), place(at(i))))
    df = df.withColumn("clash", F.when(F.col("packed").isNotNull(), differ).otherwise(F.col("again")))
    plain = F.transform(places, lambda i: F.struct(word(i, 0).alias("a"), word(i, 1).alias("b"), word(i, 2).alias("c"), i.alias("i")))
    df = df.withColumn("plain", F.when(F.col("clash"), F.sort_array(plain)))

    def near(column: str, twin, place) -> Column:
        alike = lambda x, i: F.when(i > 0, twin(F.get(column, i - 1), x)).otherwise(F.lit(False)) | F.coalesce(twin(F.get(column, i + 1), x), F.lit(False))
        return F.transform(F.filter(column, alike), place)

    exact = near("plain", lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), lambda x: x["i"])
    spots = F.sort_array(F.coalesce(exact, near("packed", lambda x, y: key(x) == key(y), place)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
    step = lambda a, x: F.struct(x.alias("last"), (a["total"] + F.least(F.lit(3), x - a["last"])).cast("long").alias("total"))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(spots, start, step, lambda a: a["total"]), F.lit(0).cast("long")))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars and common (histograms).

    Null texts count as empty. Repeated rows stay.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    df = df.select("doc_id", "lang", "t", F.expr(f"regexp_extract_all(t, r'{WORD}', 0)").alias("words"), lines.alias("lines"), F.regexp_replace("t", "[a-z]+", "").alias("t1"))
    df = df.withColumn("n", F.size("words")).withColumn("t2", F.translate("t1", SPACE, ""))
    strip = lambda c, chars: F.translate(c, chars, "")
    df = df.withColumn("t3", F.regexp_replace("t2", "[A-Z]+", "")).withColumn("t4", F.regexp_replace("t3", "[0-9]+", ""))
    df = df.withColumn("t5", strip("t4", MARKS)).withColumn("t6", strip("t5", SYMBOLS))
    size = F.length
    counts = [size("t") - size("t1"), size("t2") - size("t3"), size("t3") - size("t4"), size("t4") - size("t5"), size("t5") - size("t6"), size("t6")]
    df = _with_repeated_words(df).withColumn("sub", F.filter("words", lambda w: w.isin(COMMON)))
    # one character per common word, so that counting a word is one replace; a long chain of array functions in one
    # generated method would be past the size that the JVM compiles
    code = lambda i: F.char(F.lit(_CODE) + i)
    df = df.withColumn("codes", F.array_join(F.transform("sub", lambda w: code(F.array_position(F.lit(COMMON), w))), ""))
    seen = F.transform(F.sequence(F.lit(1), F.lit(len(COMMON) + 1)), lambda i: F.when(i <= len(COMMON), size("codes") - size(F.replace("codes", code(i), F.lit("")))).otherwise(F.col("n") - F.size("sub")).cast("double"))
    return df.select(
        "doc_id", "lang", F.col("n").cast("long").alias("n_words"), (size("t") - size("t1") + size("t2")).cast("long").alias("word_chars"), (size("t5") - size("t6")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.array(*[c.cast("double") for c in counts]).alias("chars"), seen.alias("common"),
    )


def _share(column: str) -> Column:
    """The histogram over its sum; null if that is 0. ``column``_total must hold the sum."""
    total = F.col(f"{column}_total")
    return F.when(total > 0, F.transform(column, lambda x: x / total))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two normalised histograms; null if either is."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    both = lambda a, b: (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, both), F.lit(0.0), lambda s, x: s + x)))


def references(found: DataFrame, least_words: int, least_documents: int) -> DataFrame:
    """(ref_lang, ref_chars, ref_common), a row per language and one with a null ref_lang for all together."""
    good = found.where(~F.col("base_failed") & (F.col("n_words") >= least_words))
    good = good.select("lang", F.col("chars").alias("c"), F.col("common").alias("w"))
    means = [F.array(*[F.avg(F.get(c, F.lit(i))) for i in range(n)]).alias(name) for c, n, name in (("c", len(CLASSES), "ref_chars"), ("w", len(COMMON) + 1, "ref_common"))]
    by_lang = good.where("lang is not null").groupBy(F.col("lang").alias("ref_lang")).agg(*means, F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_documents).drop("n")
    return by_lang.unionByName(good.agg(*means).withColumn("ref_lang", F.lit(None).cast("string")))


def judge(docs: DataFrame, char_limit: float = 0.3, word_limit: float = 0.31, least_chars: int = 200, least_words: int = 100, least_documents: int = 20) -> DataFrame:
    """The features of every row of ``docs`` (doc_id, text, lang) with char_distance, word_distance, base_failed and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: not base_failed, and
    no distance that is judged is over its limit; character classes are judged from ``least_chars`` characters on,
    common words from ``least_words`` words on. An empty table gives an empty result. Other columns are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = features(docs).withColumn("base_failed", failed)
    for c in ("chars", "common"):
        found = found.withColumn(f"{c}_total", F.aggregate(c, F.lit(0.0), lambda s, x: s + x)).withColumn(c, _share(c))
    found = materialize(found, "rule-features")
    refs = materialize(references(found, least_words, least_documents), "rule-references")
    own, rest = refs.where("ref_lang is not null"), refs.where("ref_lang is null").first()  # that of all languages: one row
    known = lambda name: (F.lit(None) if rest is None or rest[name] is None else F.array(*map(F.lit, rest[name]))).cast("array<double>").alias(name.replace("ref", "all"))
    out = found.join(own, found.lang == own.ref_lang, "left").select("*", known("ref_chars"), known("ref_common"))
    chars = F.when(F.col("chars_total") >= least_chars, jensen_shannon(F.col("chars"), F.coalesce("ref_chars", "all_chars")))
    words = F.when(F.col("n_words") >= least_words, jensen_shannon(F.col("common"), F.coalesce("ref_common", "all_common")))
    out = out.withColumn("char_distance", chars).withColumn("word_distance", words)
    fine = (F.coalesce("char_distance", F.lit(0.0)) <= char_limit) & (F.coalesce("word_distance", F.lit(0.0)) <= word_limit)
    return out.withColumn("kept", ~F.col("base_failed") & fine)


def op6_rules(spark, sf_dir):
    found = judge(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[F.round(c, 6).alias(c) for c in ("char_distance", "word_distance")])
