"""DuckDB SQL of the matching and censoring queries, for comparing results."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from .functions.transformers import Collapse, Keep, Remap, Transformer, fused
from .plans.patterns import BlacklistedTerm, escaped, to_regex


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def chain_sql(base: str, chain: Iterable[Transformer], prefix: str = "n") -> tuple[str, str]:
    """CTEs that turn relation ``base`` (with ``k`` columns and ``t``) into one with ``cs`` (kept characters) and ``pl``
    (their 0-based places), and the name of the last one. Texts must have no astral characters."""
    ctes = [f"{prefix}0 as (select * exclude (t), t, regexp_extract_all(t, '(?s).') as cs, range(0, length(t)) as pl from {base})"]
    last = f"{prefix}0"
    for i, step in enumerate(fused(chain), 1):
        name = f"{prefix}{i}"
        if isinstance(step, Remap):
            cs = f"regexp_extract_all(translate(array_to_string(cs, ''), {quoted(''.join(step.table))}, {quoted(''.join(step.table.values()))}), '(?s).')"
            ctes.append(f"{name} as (select * replace ({cs} as cs) from {last})")
        else:
            if isinstance(step, Keep):
                keep = f"regexp_matches(cs[i], '^[{step.chars}]$')"
            elif isinstance(step, Collapse):
                limit = lambda n: "true" if math.isinf(n) else "false" if n <= 0 else f"(i <= {math.ceil(n)} or {' or '.join(f'cs[i] <> cs[i - {d}]' for d in range(1, math.ceil(n) + 1))})"
                keep = "case " + "".join(f"when cs[i] = {quoted(c)} then {limit(n)} " for c, n in step.custom.items()) + f"else {limit(step.default)} end" if step.custom else limit(step.default)
            else:
                raise TypeError("a Python transformer has no SQL")
            ctes.append(f"{name}k as (select *, list_filter(range(1, len(cs) + 1), lambda i: {keep}) as kept from {last})")
            ctes.append(f"{name} as (select * exclude (kept) replace (list_transform(kept, lambda i: cs[i]) as cs, list_transform(kept, lambda i: pl[i]) as pl) from {name}k)")
        last = name
    return ", ".join(ctes), last


def spans_sql(base: str, keys: Sequence[str], rules: Sequence[tuple[int, str]], chain: Iterable[Transformer], prefix: str) -> tuple[str, str]:
    """CTEs down to (keys, term_id, start_index, end_index, match_length) of all scans of RE2 rules."""
    ctes, last = chain_sql(base, chain, f"{prefix}n")
    values = ", ".join(f"({i}, {quoted(r)})" for i, r in rules)
    k = ", ".join(keys)
    return (
        f"{ctes}, {prefix}v as (select {k}, pl, array_to_string(cs, '') as v from {last}), {prefix}r(term_id, rx) as (values {values}), "
        f"{prefix}g as (select {k}, pl, term_id, string_split_regex(v, rx) as g, regexp_extract_all(v, rx) as m from {prefix}v join {prefix}r on regexp_matches(v, rx)), "
        f"{prefix}e as (select *, unnest(range(1, len(m) + 1)) as j from {prefix}g), "
        f"{prefix}s as (select *, (list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0))::bigint as s, length(m[j]) as n from {prefix}e), "
        f"{prefix}x as (select {k}, term_id, pl[s + 1]::int as start_index, pl[s + n]::int as end_index, n::int as match_length from {prefix}s)"
    ), f"{prefix}x"


def matches_sql(table: str, keys: Sequence[str], terms: Sequence[BlacklistedTerm], whitelist: Sequence[str], black, white, text: str = "text", skip: Iterable[int] = ()) -> tuple[str, str]:
    """A WITH clause and the relation of the matches that no allowed span contains."""
    k = ", ".join(keys)
    rules = [(t.id, to_regex(t.pattern, "re2")) for t in terms if t.id not in set(skip)]
    base = f"b as (select {k}, {text} as t from {table} where {text} is not null)"
    first, found = spans_sql("b", keys, rules, black, "m")
    if not whitelist:
        return f"with {base}, {first}", found
    second, shut = spans_sql("b", keys, [(i, "(?s)" + escaped(w)) for i, w in enumerate(dict.fromkeys(whitelist))], white, "w")
    same = " and ".join(f"w.{c} = m.{c}" for c in keys)
    free = f"f as (select * from {found} m where not exists (select 1 from {shut} w where {same} and w.start_index <= m.start_index and m.end_index <= w.end_index))"
    return f"with {base}, {first}, {second}, {free}", "f"


def censor_sql(table: str, keys: Sequence[str], matches: tuple[str, str], middle: str, text: str = "text") -> str:
    """Censored texts by window functions; ``middle`` is SQL over t, s (start), e (end), n (length), over and ahead."""
    clause, found = matches
    k, order = ", ".join(keys), "order by start_index, end_index, term_id"
    same = " and ".join(f"a.{c} = d.{c}" for c in keys)
    return f"""{clause},
w as (select *, coalesce(max(end_index) over (partition by {k} {order} rows between unbounded preceding and 1 preceding) + 1, 0) as prev,
  lead(start_index) over (partition by {k} {order}) as ns, lead(end_index) over (partition by {k} {order}) as ne from {found}),
c as (select w.*, t, greatest(prev, start_index) as s, end_index as e, match_length as n, start_index < prev as over, coalesce(ns <= end_index and end_index < ne, false) as ahead
  from w join b using ({k}) where prev <= end_index),
a as (select {k}, string_agg((case when over then '' else substr(t, prev + 1, start_index - prev) end) || {middle}, '' {order}) as done, max(end_index) as stop from c group by {k})
select {', '.join(f'd.{c}' for c in keys)}, case when a.done is null then d.{text} else a.done || substr(d.{text}, a.stop + 2) end as censored
from {table} d left join a on {same}"""
