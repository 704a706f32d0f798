"""DuckDB SQL of the training-data operators that SQL can express, made from the operators' own parameters."""

from __future__ import annotations

import math

from .common import WORD
from .licenses import PHRASES, TEMPLATES, tokens
from .rules import COMMON, MARKS, SYMBOLS
from .substring import WINDOW


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def licenses_sql(threshold: float = 0.8, templates=TEMPLATES, phrases=PHRASES) -> str:
    """Every block against every template, without prefixes or positions; phrases at every word."""
    rows, longest = [], 0
    for k, (text, label) in enumerate((*templates, *phrases)):
        words = [w.decode() for w in tokens(text.encode())]
        kinds, phrase, longest = sorted(set(words)), k >= len(templates), max(longest, len(words))
        need = len(kinds) if phrase else math.ceil(threshold * len(kinds) - 1e-9)
        rows.append(f"({k}, {_text(label)}, {str(phrase).lower()}, {need}, {_list(kinds)}, {_list(words)})")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with template(k, label, phrase, need, kinds, row) as (values {", ".join(rows)}
), doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from documents
), block as (
  select doc_id, words[start + 1 : start + {2 * longest}] as words
  from (select doc_id, words, unnest(range(0, greatest(1, len(words) - {longest}), {longest})) as start from doc)
), near as (
  select doc_id, label, len(list_intersect(words, kinds))::double / len(kinds) as share
  from block, template where not phrase and len(list_intersect(words, kinds)) >= need
), place as (
  select doc_id, k, label, i from (select doc_id, words, unnest(range(0, len(words))) as i from doc) as spot, template
  where phrase and words[i + 1] = row[1] and words[i + 1 : i + len(row)] = row
), base as (
  select doc_id, count(*)::bigint as n_base, min(i)::bigint as first_word, max(i)::bigint as last_word, string_agg(distinct label, ',' order by label) as base_labels from place group by doc_id
), every as (
  select doc_id, string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from (select doc_id, label, share from near union all select doc_id, label, 1.0::double from place) group by doc_id
)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from doc left join base using (doc_id) left join every using (doc_id)
"""


def substring_sql(window: int = WINDOW) -> str:
    """All windows grouped by their words."""
    return f"""
with doc as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents
), spot as (
  select doc_id, words, unnest(range(1, len(words) - {window - 2})) as i from doc where len(words) >= {window}
), judged as (
  select doc_id, i, min(doc_id) over (partition by array_to_string(words[i : i + {window - 1}], ' ')) as low from spot
), gone as (
  select distinct doc_id, unnest(range(i, i + {window})) as i from judged where low < doc_id
), word as (
  select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from doc
), kept as (
  select doc_id, count(*) as n_kept, string_agg(word, ' ' order by i) as kept from word anti join gone using (doc_id, i) group by doc_id
)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n_kept, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from doc left join kept using (doc_id)
"""


def rules_sql(char_limit: float = 0.3, word_limit: float = 0.31, least_chars: int = 200, least_words: int = 100, least_documents: int = 20) -> str:
    """Counts, language references and distances; the distances are rounded as the query's are."""
    escaped = lambda chars: "".join("\\" + c for c in chars).replace("'", "''")
    kinds = ["a-z", "A-Z", "0-9", escaped(MARKS), escaped(SYMBOLS)]
    count = lambda kind: f"length(regexp_replace(t, '[^{kind}]', '', 'g'))"
    mean = lambda name, where: f"""
  select lang, list(v order by i) as {name} from (
    select lang, i, avg(v) as v from (select lang, unnest({name}) as v, unnest(range(len({name}))) as i from good) group by {where}
  ) group by lang"""  # noqa: E731
    part = lambda a, b: f"case when {a} > 0 then {a} * log2({a} / (({a} + {b}) / 2)) else 0.0 end"
    js = lambda p, q: f"sqrt(greatest(0.0::double, list_sum([({part('x[1]', 'x[2]')} + {part('x[2]', 'x[1]')}) / 2 for x in list_zip({p}, {q})])))"
    return f"""
with doc as (
  select doc_id, lang, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{WORD}') as words,
    [x for x in str_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '{WORD}')] as lines from documents
), spot as (
  select doc_id, words, unnest(range(1, len(words) - 1)) as i from doc where len(words) >= 3
), again as (
  select doc_id, i, count(*) over (partition by doc_id, words[i : i + 2]) as n from spot
), inside as (
  select doc_id, count(distinct k) as n from (select doc_id, unnest([i, i + 1, i + 2]) as k from again where n > 1) group by doc_id
), word as (
  select doc_id, w, count(*) as n from (select doc_id, unnest(words) as w from doc) group by all
), common as (
  select doc_id, list(coalesce(n, 0)::double order by i) as seen
  from (select doc_id, unnest({_list(COMMON)}) as w, unnest(range({len(COMMON)})) as i from doc) left join word using (doc_id, w) group by doc_id
), counted as (
  select doc_id, lang, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars, {count(kinds[4])}::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
    [{", ".join(map(count, kinds))}]::double[] as chars, seen
  from doc join common using (doc_id) left join inside using (doc_id)
), shared as (
  select * exclude (chars, seen), n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    case when word_chars > 0 then [x / word_chars for x in list_append(chars, (word_chars - list_sum(chars))::double)] end as chars,
    case when n_words > 0 then [x / n_words for x in list_append(seen, (n_words - list_sum(seen))::double)] end as common
  from counted
), good as (
  select * from shared where not base_failed and n_words >= {least_words}
), many as (
  select lang from good where lang is not null group by lang having count(*) >= {least_documents}
), ref_chars as ({mean("chars", "lang, i")}
), ref_common as ({mean("common", "lang, i")}
), own as (
  select lang, ref_chars.chars as own_chars, ref_common.common as own_common from many join ref_chars using (lang) join ref_common using (lang)
), every as (
  select (select list(v order by i) from (select i, avg(v) as v from (select unnest(chars) as v, unnest(range(len(chars))) as i from good) group by i)) as all_chars,
    (select list(v order by i) from (select i, avg(v) as v from (select unnest(common) as v, unnest(range(len(common))) as i from good) group by i)) as all_common
), measured as (
  select shared.*, case when word_chars >= {least_chars} then {js("chars", "coalesce(own_chars, all_chars)")} end as c,
    case when n_words >= {least_words} then {js("common", "coalesce(own_common, all_common)")} end as w
  from shared left join own on shared.lang = own.lang cross join every
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(c, 0) <= {char_limit} and coalesce(w, 0) <= {word_limit} as kept, round(c, 6) as char_distance, round(w, 6) as word_distance
from measured
"""


ORACLE_SQL = {"op6_rules": rules_sql(), "op8_licenses": licenses_sql(), "op10_substring": substring_sql()}
