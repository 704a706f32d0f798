"""Every registered query of the moderation engine with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import transformers as T
from .functions.characters import characters, invert_case, is_alphabetic, is_digit, is_lower_case, is_upper_case, is_word_char
from .operators import censor as C
from .operators.matcher import PhraseMatcher, contained
from .plans.patterns import ParserError, pattern, to_regex
from .sources.dataset import DataSet, terms_of
from .sources.english import english_dataset, english_recommended_transformers
from .sources.tables import search_words, table
from .sql import censor_sql, chain_sql, matches_sql, quoted, spans_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_DUPLICATES = T.collapse_duplicates(1, {"e": 2, "l": 0, " ": 1})
CHAINS = {
    "lower_ascii": [T.to_ascii_lower_case()], "leet": [T.resolve_leet_speak()], "confusables": [T.resolve_confusables()],
    "remap": [T.remap_characters([("x", "ab"), ("y", "bc"), ("é", "e")])], "skip_non_alpha": [T.skip_non_alphabetic()],
    "collapse_default": [T.collapse_duplicates()], "collapse_custom": [_DUPLICATES],
    "normalise_preset_black": english_recommended_transformers()["blacklist_matcher_transformers"],
    "normalise_preset_white": english_recommended_transformers()["whitelist_matcher_transformers"],
}
#: Mild insults and frequent syllables of the test data, so that optionals, wildcards, boundaries and overlaps all occur.
INSULTS = ["trash", "|clown|", "idiot[s]", "sc?m", "worth[less]", "mor[o]n", "path?tic", "lo[s]er", "|disgust", "st[u]pid"]
ALLOWED = ["thorn", "erth", "idiot the", "the er", "tionth"]
LOWER = [T.to_ascii_lower_case()]
SIMPLE = {"literal_matches": ["idiot", "tion", "stupid"], "optional_matches": ["th[er]e", "[o]nti", "worth[less]"], "wildcard_matches": ["th?n", "id?ot", "e?er"], "boundary_matches": ["|the|", "|on", "er|", "|clown|"]}


#: Fixed values, written by hand: patterns with their rules and with their errors.
RULES = [("abc", "(?s)abc"), ("|a?b|", r"(?s)\ba[\x{0}-\x{FFFF}]b\b"), ("a[b]c", "(?s)a(?:b)?c"), ("x[?]y", r"(?s)x(?:[\x{0}-\x{FFFF}])?y"), (r"\?\|", r"(?s)\?\|")]
ERRORS = [
    ("a]", "1:2: Unexpected ']' with no corresponding '['."), ("[aa", "1:3: Unexpected unclosed '['."), ("[[a]]", "1:2: Unexpected nested optional node."),
    ("hello foo\\", "1:10: Unexpected trailing backslash."), ("[]", "1:2: Unexpected ']' with no corresponding '['."), ("a\nb]", "2:2: Unexpected ']' with no corresponding '['."),
    ("oopsies \\:", "1:10: Cannot escape character ':'; the only characters that can be escaped are the following: '\\', '[', ']', '?', '|'."),
    ("su|p", "1:3: Boundary assertions are not supported in this position; they are only allowed at the start / end of the pattern."), ("[o]k", ""),
]


def _error(source: str) -> str:
    try:
        pattern(source)
    except ParserError as e:
        return str(e)
    return ""


def spread(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table, dealt over all cores if it is fewer files than there are cores."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _matches(name: str, matcher: PhraseMatcher, keys: list[str], terms, allowed, black, white, where: str = "documents", text: str = "text") -> tuple[str, str]:
    _register(name, lambda s, d: matcher.all_matches(spread(s, d, where), text, keys))
    clause = matches_sql(where, keys, terms, allowed, black, white, text)
    ORACLE_SQL[name] = f"{clause[0]} select * from {clause[1]}"
    return clause


def _build() -> None:
    for name, chain in CHAINS.items():
        ctes, last = chain_sql("b", chain)
        sql = f"with b as (select doc_id, text as t from documents), {ctes} select doc_id, array_to_string(cs, '') as value from {last}"
        _register(name, lambda s, d, chain=chain: spread(s, d).select("doc_id", T.normalised(F.col("text"), chain).alias("value")), sql)

    for name, patterns in SIMPLE.items():
        terms = terms_of(patterns)
        _matches(name, PhraseMatcher(terms), ["doc_id"], terms, [], [], [])

    terms = terms_of([*INSULTS, "th[e]re", "|th", "ther", "er"])
    matcher = PhraseMatcher(terms, ALLOWED, LOWER, LOWER)
    found = _matches("matches_whitelisted", matcher, ["doc_id"], terms, ALLOWED, LOWER, LOWER)
    ctes, last = spans_sql("b", ["doc_id"], [(i, "(?s)" + w) for i, w in enumerate(ALLOWED)], LOWER, "w")
    _register(
        "whitelist_intervals",
        lambda s, d: spread(s, d).select("doc_id", F.explode(matcher.whitelist_intervals(F.col("text"))).alias("w")).select("doc_id", "w.*"),
        f"with b as (select doc_id, text as t from documents), {ctes} select doc_id, start_index as lo, end_index as hi from {last}",
    )
    _register(
        "interval_containment",
        lambda s, d: spread(s, d).select("doc_id", contained(matcher.whitelist_intervals(F.col("text")), F.lit(10), F.lit(12)).alias("inside")),
        f"with b as (select doc_id, text as t from documents), {ctes} select doc_id, exists (select 1 from {last} w where w.doc_id = d.doc_id and lo <= 10 and 12 <= hi) as inside from documents d".replace("lo <=", "w.start_index <=").replace("<= hi", "<= w.end_index"),
    )
    _register(
        "matches_sorted",
        lambda s, d: spread(s, d).select("doc_id", F.posexplode(matcher.matches(F.col("text"), sorted=True)).alias("place", "m")).select("doc_id", "place", "m.*"),
        f"{found[0]} select *, (row_number() over (partition by doc_id order by start_index, end_index, term_id) - 1)::int as place from {found[1]}",
    )
    single = terms_of(["idiot"])
    _register(
        "single_term_has_match",
        lambda s, d: PhraseMatcher(single, (), LOWER).filter(spread(s, d)).select("doc_id"),
        "select doc_id from documents where contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'idiot')",
    )

    preset, advised = english_dataset(), english_recommended_transformers()
    built = preset.build()
    english = PhraseMatcher(**built, **advised)
    args = (built["blacklisted_terms"], built["whitelisted_terms"], advised["blacklist_matcher_transformers"], advised["whitelist_matcher_transformers"])
    docs = _matches("preset_matches", english, ["doc_id"], *args)
    _matches("preset_matches_conversations", english, ["conv_id", "turn"], *args, where="conversations")
    _matches("preset_matches_pages", english, ["page_id"], *args, where="pages", text="html")
    _register("preset_has_match", lambda s, d: spread(s, d).select("doc_id", english.has_match(F.col("text")).alias("has_match")), f"{docs[0]} select doc_id, doc_id in (select doc_id from {docs[1]}) as has_match from documents")
    metadata = ", ".join(f"({t.id}, {quoted(preset.phrase_metadata(t.id))})" for t in built["blacklisted_terms"])
    _register("matches_with_metadata", lambda s, d: preset.with_metadata(english.all_matches(spread(s, d), keep=["doc_id"])), f"{docs[0]}, p(term_id, phrase_metadata) as (values {metadata}) select * from {docs[1]} join p using (term_id)")

    small = DataSet().add_phrase(lambda p: p.set_metadata("first").add_pattern("a[b]").add_pattern("|c|").add_whitelisted_term("abc"))
    small = small.add_phrase(lambda p: p.set_metadata("second").add_pattern("d?e"))
    rows = lambda data: "select * from (values " + ", ".join(f"({i}, {k}, {quoted(p)}, {'null' if m is None else quoted(m)})" for i, k, p, m in data._rows()) + ") t(term_id, phrase_id, pattern, metadata)"
    _register("dictionary_terms", lambda s, d: preset.terms(s), rows(preset))
    union = "(0, 0, 'a[b]', 'first'), (1, 0, '|c|', 'first'), (2, 1, 'd?e', 'second'), (3, 2, 'a[b]', 'first'), (4, 2, '|c|', 'first'), (5, 3, 'd?e', 'second')"
    _register("dictionary_union", lambda s, d: small.add_all(small).terms(s), f"select * from (values {union}) t(term_id, phrase_id, pattern, metadata)")
    _register(
        "dictionary_removed", lambda s, d: preset.remove_phrases_if(lambda p: p.metadata.startswith("a")).terms(s),
        f"select (row_number() over (order by term_id) - 1)::int as term_id, (dense_rank() over (order by phrase_id) - 1)::int as phrase_id, pattern, metadata from ({rows(preset)}) where not starts_with(metadata, 'a')",
    )

    strategies = {
        "censor_asterisk": (C.asterisks(), "repeat('*', n)"),
        "censor_fixed_phrase": (C.fixed_phrase("[gone]"), "'[gone]'"),
        "censor_fixed_char": (C.fixed_char("x"), "repeat('x', n)"),
        "censor_keep_start": (C.keep_start(C.asterisks()), "case when over then repeat('*', n) else substr(t, s + 1, 1) || repeat('*', n - 1) end"),
        "censor_keep_end": (C.keep_end(C.asterisks()), "case when ahead then repeat('*', n) else repeat('*', n - 1) || substr(t, e + 1, 1) end"),
        "censor_keep_both": (C.keep_start(C.keep_end(C.asterisks())), "(case when over then '' else substr(t, s + 1, 1) end) || repeat('*', n - (case when over then 0 else 1 end) - (case when ahead then 0 else 1 end)) || (case when ahead then '' else substr(t, e + 1, 1) end)"),
    }
    for name, (strategy, middle) in strategies.items():
        _register(
            name, lambda s, d, x=strategy: spread(s, d).select("doc_id", "text", matcher.matches(F.col("text")).alias("m")).select("doc_id", C.TextCensor(x).apply_to(F.col("text"), F.col("m")).alias("censored")),
            censor_sql("documents", ["doc_id"], found, middle),
        )
    overlaps = terms_of(["ther", "here", "the", "re", "er th"])
    crossing = PhraseMatcher(overlaps)
    _register(
        "censor_overlaps", lambda s, d: spread(s, d).select("doc_id", "text", crossing.matches(F.col("text")).alias("m")).select("doc_id", C.TextCensor(C.fixed_char(".")).apply_to(F.col("text"), F.col("m")).alias("censored")),
        censor_sql("documents", ["doc_id"], matches_sql("documents", ["doc_id"], overlaps, [], [], []), "repeat('.', n)"),
    )

    def grawlix_shape(s: SparkSession, d: DataFrame) -> DataFrame:
        text = C.TextCensor().apply_to(F.col("text"), F.col("m"))
        cut = spread(s, d).select("doc_id", english.matches(F.col("text")).alias("m"), "text").select("doc_id", "text", text.alias("censored"))
        return cut.select("doc_id", (F.length("censored") - F.length("text")).alias("longer"), (F.col("censored") != F.col("text")).alias("changed"))

    shape = censor_sql("documents", ["doc_id"], docs, "repeat('~', n)")
    _register("censor_grawlix_shape", grawlix_shape, f"select c.doc_id, (length(censored) - length(text))::int as longer, contains(censored, '~') as changed from ({shape}) c join documents using (doc_id)")

    tokens = lambda s, d: spread(s, d).select(F.explode(F.split("text", r"[ \n]")).alias("word")).where("word <> ''")
    split = "select word from (select unnest(string_split_regex(text, '[ \\n]')) as word from documents) where word <> '' and "
    for name, query, sql in (("word_prefix", "^thin", "starts_with(word, 'thin')"), ("word_suffix", "tion$", "ends_with(word, 'tion')"), ("word_contains", "clow", "contains(word, 'clow')")):
        _register(name, lambda s, d, q=query: search_words(tokens(s, d), q), split + sql)

    toxic = terms_of(INSULTS)
    tester = PhraseMatcher(toxic, (), LOWER)
    clause = matches_sql("documents", ["doc_id"], toxic, [], LOWER, [])

    def confusion(s: SparkSession, d: DataFrame) -> DataFrame:
        labelled = spread(s, d).select("doc_id", "text").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id")
        hit = labelled.select("toxic", tester.has_match(F.col("text")).alias("flagged"))
        return hit.groupBy("toxic", "flagged").agg(F.count(F.lit(1)).alias("documents"))

    _register("toxic_confusion", confusion, f"{clause[0]} select toxic, doc_id in (select doc_id from {clause[1]}) as flagged, count(*) as documents from documents join labels using (doc_id) group by all")
    _register("matches_by_term", lambda s, d: english.all_matches(spread(s, d)).groupBy("term_id").agg(F.count(F.lit(1)).alias("n")), f"{docs[0]} select term_id, count(*) as n from {docs[1]} group by term_id")
    rules = [pattern(p) for p, _ in RULES]
    _register("compiled_rules", lambda s, d: s.createDataFrame([(i, to_regex(p, "re2")) for i, p in enumerate(rules)], "term_id int, rule string"), "select * from (values " + ", ".join(f"({i}, {quoted(rule)})" for i, (_, rule) in enumerate(RULES)) + ") t(term_id, rule)")
    _register("pattern_errors", lambda s, d: s.createDataFrame([(p, _error(p)) for p, _ in ERRORS], "pattern string, error string"), "select * from (values " + ", ".join(f"({quoted(p)}, {quoted(e)})" for p, e in ERRORS) + ") t(pattern, error)")

    # transformers in Python against the SQL of those they imitate
    simple = T.create_simple_transformer(lambda c: c.lower() if c.isascii() else c)

    def once():
        last = [None]

        def keep(c):
            last[0], before = c, last[0]
            return None if c == before else c

        return keep

    for name, black, same in (("transformer_simple", [simple], LOWER), ("transformer_stateful", [T.create_stateful_transformer(once)], [T.collapse_duplicates()])):
        _matches(name, PhraseMatcher(toxic, (), black), ["doc_id"], toxic, [], same, [])

    # random characters: their number, their set, and none beside itself
    alone = [t for t in terms if t.id < len(INSULTS)]
    matcher_alone = PhraseMatcher(alone, (), LOWER)
    alone_sql = censor_sql("documents", ["doc_id"], matches_sql("documents", ["doc_id"], alone, [], LOWER, []), "repeat('~', n)")

    def random_alone(s: SparkSession, d: DataFrame) -> DataFrame:
        text = C.TextCensor(C.random_char_from_set("~^")).apply_to(F.col("text"), F.col("m"))
        cut = spread(s, d).select("doc_id", matcher_alone.matches(F.col("text")).alias("m"), "text").select("doc_id", text.alias("c"))
        return cut.select("doc_id", F.translate("c", "^", "~").alias("shape"))

    _register("censor_random_shape", random_alone, f"select doc_id, translate(censored, '^', '~') as shape from ({alone_sql})")
    custom = lambda c: F.concat(F.lit("<"), F.upper(C._cut(c.utf16, c.start_index, c.end_index - c.start_index + 1)), F.lit(">"))
    _register(
        "censor_custom", lambda s, d: spread(s, d).select("doc_id", "text", matcher.matches(F.col("text")).alias("m")).select("doc_id", C.TextCensor().set_strategy(custom).apply_to(F.col("text"), F.col("m")).alias("censored")),
        censor_sql("documents", ["doc_id"], found, "'<' || upper(substr(t, s + 1, e - s + 1)) || '>'"),
    )

    def counts(s: SparkSession, d: DataFrame) -> DataFrame:
        codes = spread(s, d).select("doc_id", F.transform(characters(F.col("text")), lambda c: c["code_point"]).alias("c"))
        n = lambda test: F.size(F.filter("c", test)).cast("long")
        return codes.select("doc_id", n(is_upper_case).alias("upper"), n(is_lower_case).alias("lower"), n(is_digit).alias("digits"), n(is_word_char).alias("word_chars"))

    many = lambda kind: f"length(regexp_replace(text, '[^{kind}]', '', 'g'))::bigint"
    _register("character_counts", counts, f"select doc_id, {many('A-Z')} as upper, {many('a-z')} as lower, {many('0-9')} as digits, {many('A-Za-z0-9')} as word_chars from documents")
    _register(
        "character_positions",
        lambda s, d: spread(s, d, "conversations").select("conv_id", "turn", F.explode(characters(F.col("text"))).alias("c")).where(is_alphabetic(F.col("c.code_point"))).groupBy("conv_id", "turn").agg(F.sum("c.position").cast("long").alias("places"), F.sum(invert_case(F.col("c.code_point"))).cast("long").alias("inverted")),
        "select conv_id, turn, sum(i - 1)::bigint as places, sum(xor(unicode(c), 32))::bigint as inverted from (select conv_id, turn, unnest(range(1, length(text) + 1)) as i, unnest(regexp_extract_all(text, '(?s).')) as c from conversations) where regexp_matches(c, '[A-Za-z]') group by conv_id, turn",
    )


_build()
