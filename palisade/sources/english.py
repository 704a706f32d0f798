"""The English preset: phrases with their patterns and allowed texts, and the recommended transformers.

The words are from the cuss word list, with modifications: MIT License, Copyright (c) 2016 Titus Wormer. Permission is
granted, free of charge, to any person obtaining a copy to deal in it without restriction, provided that this notice is
included; it is provided "as is", without warranty of any kind.
"""

from __future__ import annotations

import functools
import math

from ..functions.transformers import collapse_duplicates, resolve_confusables, resolve_leet_speak, to_ascii_lower_case
from .dataset import DataSet

# Fixed values: (word, patterns, allowed texts); term ids count the patterns in this order.
PHRASES = (
    ("abo", ("|ab[b]o[s]|",), ()),
    ("abeed", ("ab[b]eed",), ()),
    ("africoon", ("africoon",), ()),
    ("anal", ("|anal", "danal", "eanal", "fanal", "ganal", "ianal", "janal", "kanal", "lanal", "lanal", "oanal|", "panal", "qanal", "ranal", "sanal", "tanal", "uanal", "vanal", "wanal", "xanal", "yanal", "zanal"), ("analabos", "analagous", "analav", "analy", "analog", "an al", "fan al", "gan al", "ian al", "trojan al", "lan al", "lan al", "pan al", "tan al", "uan al", "van al", "texan al")),
    ("anus", ("anus",), ("an us", "tetanus", "uranus", "janus", "manus")),
    ("arabush", ("arab[b]ush",), ()),
    ("arse", ("|ars[s]e",), ("arsen",)),
    ("ass", ("|ass",), ("45s", "assa", "assem", "assen", "asser", "assess", "asset", "assev", "assi", "assoc", "assoi", "assu")),
    ("bastard", ("bas[s]tard",), ()),
    ("bestiality", ("be[e][a]s[s]tial",), ()),
    ("bitch", ("bitch", "bich|"), ()),
    ("blowjob", ("b[b]l[l][o]wj[o]b",), ()),
    ("bollocks", ("bol[l]ock",), ()),
    ("boob", ("boob",), ()),
    ("boonga", ("boonga",), ("baboon ga",)),
    ("buttplug", ("buttplug",), ()),
    ("chingchong", ("chingchong",), ()),
    ("chink", ("chink",), ("chin k",)),
    ("cock", ("|cock|", "|cocks", "|cockp", "|cocke[e]|"), ("cockney",)),
    ("cuck", ("cuck",), ("cuckoo",)),
    ("cum", ("|cum",), ("cumu", "cumb")),
    ("cunt", ("|cunt", "cunt|"), ()),
    ("deepthroat", ("deepthro[o]at", "deepthro[o]t"), ()),
    ("dick", ("|dck|", "dick"), ("benedick", "dickens", "dickety", "dickory")),
    ("dildo", ("dildo",), ()),
    ("doggystyle", ("d[o]g[g]ys[s]t[y]l[l]",), ()),
    ("double penetration", ("double penetra",), ()),
    ("dyke", ("dyke",), ("van dyke",)),
    ("ejaculate", ("e[e]jacul", "e[e]jakul", "e[e]acul[l]ate"), ()),
    ("fag", ("|fag", "fggot"), ()),
    ("felch", ("fe[e]l[l]ch",), ()),
    ("fellatio", ("f[e][e]llat",), ()),
    ("finger bang", ("fingerbang",), ()),
    ("fisting", ("fistin",), ()),
    ("fuck", ("f[?]ck", "|fk", "|fu|", "|fuk"), ("fick", "kung-fu", "kung fu")),
    ("gangbang", ("g[?]ngbang",), ()),
    ("handjob", ("h[?]ndjob",), ()),
    ("hentai", ("h[e][e]ntai",), ()),
    ("hooker", ("hooker",), ()),
    ("incest", ("incest",), ()),
    ("jerk off", ("jerkoff",), ()),
    ("jizz", ("jizz",), ()),
    ("kike", ("kike",), ()),
    ("lubejob", ("lubejob",), ()),
    ("masturbate", ("m[?]sturbate", "masterbate"), ()),
    ("negro", ("negro",), ("montenegro", "negron", "stoneground", "winegrow")),
    ("nigger", ("n[i]gger", "n[i]gga", "|nig|", "|nigs|"), ("snigger",)),
    ("orgasm", ("[or]gasm",), ("gasma",)),
    ("orgy", ("orgy", "orgies"), ("porgy",)),
    ("penis", ("pe[e]nis", "|pnis"), ("pen is",)),
    ("piss", ("|piss",), ()),
    ("porn", ("|prn|", "porn"), ("p orna",)),
    ("prick", ("|prick[s]|",), ()),
    ("pussy", ("p[u]ssy",), ()),
    ("rape", ("|rape", "|rapis[s]t"), ("rapper",)),
    ("retard", ("retard",), ()),
    ("scat", ("|s[s]cat|",), ()),
    ("semen", ("|s[s]e[e]me[e]n",), ()),
    ("sex", ("|s[s]e[e]x|", "|s[s]e[e]xy|"), ()),
    ("shit", ("|shit", "shit|"), ("s hit", "sh it", "shi t", "shitake")),
    ("slut", ("s[s]lut",), ()),
    ("spastic", ("|spastic",), ()),
    ("tit", ("|tit|", "|tits|", "|titt", "|tiddies", "|tities"), ()),
    ("tranny", ("|trany",), ()),
    ("turd", ("|turd",), ("turducken",)),
    ("twat", ("|twat",), ("twattle",)),
    ("vagina", ("vagina", "|v[?]gina"), ()),
    ("wank", ("|wank",), ()),
    ("whore", ("|wh[o]re|", "|who[o]res[s]|"), ("who're",)),
)
#: Doubled letters that occur in the patterns keep two of a run.
DOUBLED = "beolsg"


@functools.cache
def english_dataset() -> DataSet:
    """Every phrase with the word as its metadata."""
    data = DataSet()
    for word, patterns, allowed in PHRASES:

        def build(phrase, word=word, patterns=patterns, allowed=allowed):
            phrase = phrase.set_metadata(word)
            for p in patterns:
                phrase = phrase.add_pattern(p)
            for term in allowed:
                phrase = phrase.add_whitelisted_term(term)
            return phrase

        data = data.add_phrase(build)
    return data


def english_recommended_transformers() -> dict[str, list]:
    """Look-alikes, leet-speak, lower case and collapsed runs for patterns; lower case and single spaces for allowed texts."""
    return {
        "blacklist_matcher_transformers": [resolve_confusables(), resolve_leet_speak(), to_ascii_lower_case(), collapse_duplicates(1, dict.fromkeys(DOUBLED, 2))],
        "whitelist_matcher_transformers": [to_ascii_lower_case(), collapse_duplicates(math.inf, {" ": 1})],
    }


def english_profane_words() -> list[str]:
    """The values that ``phrase_metadata`` of the English preset can have."""
    return list(dict.fromkeys(word for word, _, _ in PHRASES))
