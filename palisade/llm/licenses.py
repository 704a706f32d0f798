"""License scans: exact set-similarity join of text blocks with license templates.

Blocks are overlapping windows of words, so that every stretch as long as the longest template lies in one of them.
A template's tokens are ordered by their count over the whole corpus, rarest first. A block that holds a share t of
a template's n tokens must hold one of its first n - ceil(t n) + 1 (prefix filter), must have enough different words
(length filter), and from the place of that token in both orders enough tokens must be left (positional filter).
What passes is counted exactly. Phrases are templates with share 1 whose words must also stand in a row.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, slices

#: Fixed by the contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: License notices as their publishers word them.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under the apache license version 2.0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under a creative commons attribution noncommercial 4.0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4.0 international license", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2.0", "mpl-2"),
    ("all rights reserved no part of this publication may be reproduced", "proprietary"),
)
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words of ASCII letters, digits and anything beyond ASCII, A-Z in lower case."""
    return text.lower().translate(_TABLE).split()


class Scanner:
    """Finds templates in word lists; ``counts`` are the corpus counts of template tokens."""

    def __init__(self, counts: dict[bytes, int], threshold: float = 0.8, templates=TEMPLATES, phrases=PHRASES):
        rank = {w: i for i, w in enumerate(sorted({w for t, _ in (*templates, *phrases) for w in tokens(t.encode())}, key=lambda w: (counts.get(w, 0), w)))}
        self.rank, self.sets, self.prefix = rank, [], defaultdict(list)
        for k, (text, label) in enumerate((*templates, *phrases)):
            row = tokens(text.encode())
            order, phrase = sorted(set(row), key=rank.__getitem__), k >= len(templates)
            need = len(order) if phrase else math.ceil(threshold * len(order) - 1e-9)
            self.sets.append((frozenset(order), len(order), need, label, row if phrase else None))
            for i, w in enumerate(order[: len(order) - need + 1]):
                self.prefix[w].append((k, i))
        self.window = max(len(tokens(t.encode())) for t, _ in (*templates, *phrases))

    def blocks(self, words: list[bytes]) -> Iterator[int]:
        """Starts of windows of 2 x ``window`` words, each half over the last."""
        return range(0, max(1, len(words) - self.window), self.window)

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of the phrases' places, the labels of phrases, those of all, and the largest share."""
        places, base, labels, best = set(), set(), set(), 0.0
        if self.prefix.keys().isdisjoint(words):
            return [], base, labels, best
        for start in self.blocks(words):
            block = words[start : start + 2 * self.window]
            if self.prefix.keys().isdisjoint(block):
                continue
            kinds = set(block)
            known = sorted(self.rank.keys() & kinds, key=self.rank.__getitem__)
            seen = set()
            for j, w in enumerate(known):
                for k, i in self.prefix.get(w, ()):
                    if k in seen:
                        continue
                    have, n, need, label, row = self.sets[k]
                    # the first shared token: what stands before it in either order is not shared
                    seen.add(k)
                    if len(kinds) < need or 1 + min(n - i - 1, len(known) - j - 1) < need:
                        continue
                    shared = len(have & kinds)
                    if shared < need:
                        continue
                    if row is None:
                        labels.add(label)
                        best = max(best, shared / n)
                        continue
                    here = [start + p for p, x in enumerate(block) if x == row[0] and block[p : p + len(row)] == row]
                    if here:
                        places.update((p, k) for p in here)
                        base.add(label)
                        best = 1.0
        return sorted(p for p, _ in places), base, labels | base, best


def token_counts(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> dict[bytes, int]:
    """How often each template token stands in the whole corpus; at most one entry per template token."""
    wanted = frozenset(w for t, _ in (*templates, *phrases) for w in tokens(t.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in (b for whole in batches for b in slices(whole)):
            for text in binary_texts(batch):
                total.update(filter(wanted.__contains__, tokens(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["token", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["token"]): r["n"] for r in rows}


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of ``docs`` (doc_id, text).

    A null text counts as empty: no words, empty labels, null places, score 0. score is the largest share of a
    template found (1 for a phrase), 0 if none reaches ``threshold``. Other columns are ignored.
    """
    scanner = Scanner(token_counts(docs, templates, phrases), threshold, templates, phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for text in binary_texts(batch):
                    words = tokens(text)
                    places, base, labels, score = scanner.scan(words)
                    rows.append((len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8_licenses(spark, sf_dir):
    from .common import documents

    return scan_licenses(documents(spark, sf_dir))
