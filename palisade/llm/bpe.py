"""Byte-pair encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words are compiled, with the ids that they encode to, into a minimal acyclic automaton: words share prefixes
and suffixes, every edge carries how many words lie before it, and the sum along a word's path is its number, which
points to its ids. The automaton is one file that all workers of a machine map into memory. Words that it lacks are
merged exactly by the tokenizer's ranks.
"""

from __future__ import annotations

import contextlib
import functools
import gc
import hashlib
import heapq
import json
import mmap
import os
import re
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, shared_file, slices, tidied

END = "</w>"
_ID = 24
#: An id that no token has: it marks what is not, or no longer, part of a word.
_NO = (1 << _ID) - 1
#: Words without an entry in the lexicon that a worker keeps, about; words merged together; words of one text looked up at a time.
_KEPT = 60_000
_TOGETHER = 4_096
_BLOCK = 200_000
_COUNTED = 100_000
#: Unicode white space, as a class; Python's own also takes the separators U+001C to U+001F.
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_BLANK}\p{{L}}\p{{N}}]+")
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")

# --- fixed values: where the character data of the tokenizer library and of Python differ --------------------------
#: Letters and numbers newer than the library's (first and last code points).
_NEW_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Marks newer than the library's data for composition, to which they are plain characters, and one new composition.
_NEW_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA),
    (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x11938, 0x11938), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34),
    (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
#: Capitals newer than Python's data: first, last, and the small letter of the first.
_NEW_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


def _class(ranges) -> str:
    return "".join(f"{chr(r[0])}-{chr(r[1])}" for r in ranges)


_ODD = re.compile(f"[{_class((*_NEW_LETTERS, *_NEW_MARKS, *_NEW_CAPITALS))}]")
_ODD_MARK = re.compile(f"([{_class(_NEW_MARKS)}])")
_SMALL = {a + k: small + k for a, b, small in _NEW_CAPITALS for k in range(b - a + 1)}
_SPLIT_ODD = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_class(_NEW_LETTERS)}]]+|[\p{{N}}--[{_class(_NEW_LETTERS)}]]|(?:[^{_BLANK}\p{{L}}\p{{N}}]|[{_class(_NEW_LETTERS)}])+")


@functools.cache
def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def normalized(text: str) -> str:
    """NFC, then lower case letter by letter (without the rule for a sigma at the end of a word)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pretokens(text: str) -> list[str]:
    """The words of a text without characters newer than the library's data."""
    text = normalized(text)
    return (_SPLIT_ASCII if text.isascii() else _SPLIT).findall(text)


def exact_pretokens(text: str) -> list[str]:
    """The words of any text."""
    if text.isascii() or not _ODD.search(text):
        return pretokens(text)
    pieces = (unicodedata.normalize("NFC", x) for x in _ODD_MARK.split(text))
    return _SPLIT_ODD.findall("".join(pieces).replace("Σ", "σ").lower().translate(_SMALL))


class Merges:
    """Byte-pair merges over ids: a pair packed into one number has a rank, a rank the id of what it makes."""

    def __init__(self, pairs: Iterable[int], made: list[int], units: list[int]):
        """``units`` are the ids of the 256 bytes inside a word, then of the 256 bytes at its end."""
        self.rank, self.made, self.inner, self.last = dict(zip(pairs, range(len(made)), strict=True)), made, units[:256], units[256:]

    def encode(self, word: bytes) -> list[int]:
        """Exact merges of one word: the pair with the lowest rank first, leftmost among equals."""
        parts = [self.inner[b] for b in word]
        if parts:
            parts[-1] = self.last[word[-1]]
        return self._merge_long(parts) if len(parts) > 40 else self._merge_short(parts)

    def encode_many(self, words: list[bytes]) -> list[list[int]]:
        """As ``encode`` of each word, with arrays for many of like length together; very long ones one by one."""
        found: list = [None] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > 40:
            i = order.pop()
            found[i] = self.encode(words[i])
        for at in range(0, len(order), _TOGETHER):
            some = order[at : at + _TOGETHER]
            for i, ids in zip(some, self._merge_many([words[i] for i in some]), strict=True):
                found[i] = ids
        return found

    @functools.cached_property
    def _arrays(self) -> tuple[np.ndarray, ...]:
        """The pairs in order and their ranks, each with one more that stands for none; then what ranks make, and the units."""
        pairs, ranks = np.fromiter(self.rank, np.int64), np.fromiter(self.rank.values(), np.int64)
        order = np.argsort(pairs)
        known = np.append(pairs[order], np.iinfo(np.int64).max), np.append(ranks[order], len(self.made))
        return *known, *(np.array(x, np.int64) for x in (self.made, self.inner, self.last))

    def _merge_many(self, words: list[bytes]) -> Iterator[list[int]]:
        """A round merges one pair of every word. A word is a column, its parts are linked and have a row with ``_NO`` at both ends."""
        pairs, ranks, made, inner, last = self._arrays
        n, none, sizes = len(words), len(self.made), np.fromiter(map(len, words), np.int64)
        height, raw = int(sizes.max()) + 2, np.frombuffer(b"".join(words), np.uint8)
        letters, full = np.full((n, height), _NO, np.int64), np.flatnonzero(sizes)
        letters[:, 1:-1][np.arange(height - 2) < sizes[:, None]] = inner[raw]
        letters[full, sizes[full]] = last[raw[np.cumsum(sizes)[full] - 1]]
        parts, size = letters.T.ravel(), n * height

        def ranked(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Rank and place in one number: the least of a column is the lowest rank's leftmost pair."""
            pair = left << _ID | right
            i = np.searchsorted(pairs, pair)
            return np.where(pairs[i] == pair, ranks[i], none) * size + at

        places = np.arange(size)
        after, before = places + n, places - n
        keys = np.append(ranked(parts[:-n], parts[n:], places[:-n]), np.full(n, none * size))
        columns = keys.reshape(height, n)
        while (best := columns.min(axis=0)).min() < none * size:
            rank, at = np.divmod(best[best < none * size], size)
            gone, prior, new = after[at], before[at], made[rank]
            then = after[gone]
            parts[at], parts[gone], keys[gone] = new, _NO, none * size
            after[at], before[then] = then, at
            keys[at], keys[prior] = ranked(new, parts[then], at), ranked(parts[prior], new, prior)
        rows = parts.reshape(height, n).T
        there = rows != _NO
        ids, end = rows[there].tolist(), 0
        for k in there.sum(axis=1).tolist():
            start, end = end, end + k
            yield ids[start:end]

    def _merge_short(self, parts: list[int]) -> list[int]:
        get, none = self.rank.get, len(self.made)
        found = [get(a << _ID | b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while found and (low := min(found)) < none:
            i = found.index(low)
            parts[i] = new = self.made[low]
            del parts[i + 1], found[i]
            if i < len(found):
                found[i] = get(new << _ID | parts[i + 1], none)
            if i:
                found[i - 1] = get(parts[i - 1] << _ID | new, none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """With a heap and links, so that very long words take n log n."""
        get, n = self.rank.get, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << _ID | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := get(parts[x] << _ID | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        whole = json.loads(Path(path).read_text())
        model = whole["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.tokens = {i: t for t, i in (*self.ids.items(), *self.special.items())}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.pairs = [self.ids[a] << _ID | self.ids[b] for a, b in pairs]
        self.made = [self.ids[a + b] for a, b in pairs]
        self.units = [self.ids[c + end] for end in ("", END) for c in byte_characters()]
        self.merges = Merges(self.pairs, self.made, self.units)

    def encode(self, word: str) -> list[int]:
        return self.merges.encode(word.encode())


def _packed(*parts: bytes) -> bytes:
    """Parts one after another, each at a multiple of eight bytes, behind their lengths."""
    return b"".join([struct.pack("<Q", len(parts)), struct.pack(f"<{len(parts)}Q", *map(len, parts)), *(p + bytes(-len(p) % 8) for p in parts)])


def _unpacked(data) -> list[memoryview]:
    view = memoryview(data)
    (n,) = struct.unpack_from("<Q", view)
    parts, at = [], 8 + 8 * n
    for size in struct.unpack_from(f"<{n}Q", view, 8):
        parts.append(view[at : at + size])
        at += size + -size % 8
    return parts


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file of a minimal acyclic automaton over the words, with their ids by number."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    words = sorted(entries)
    path, last = [[False, []]], b""  # a node: final, [(label, target)]
    for word in [*words, None]:
        same = 0
        while word is not None and same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        while len(path) > same + 1:  # what the next word does not share is settled, suffixes first
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(node)))
        if word is None:
            break
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    root = settle(path[0])
    counts: list[int] = []  # targets come before their sources
    for final, edges in states:
        counts.append(final + sum(counts[t] for _, t in edges))
    first, labels, targets, skips = [0], bytearray(), [], []
    for final, edges in states:
        before = int(final)
        for label, target in edges:
            labels.append(label)
            targets.append(target)
            skips.append(before)
            before += counts[target]
        first.append(len(labels))
    starts = np.concatenate(([0], np.cumsum([len(entries[w]) for w in words]))).astype(np.uint32)
    ids = np.array([i for w in words for i in entries[w]], np.uint32)
    finals = bytes(f for f, _ in states)
    return _packed(*(np.array(x, np.uint32).tobytes() for x in ([root], first, targets, skips)), starts.tobytes(), ids.tobytes(), bytes(labels), finals)


class Lexicon:
    """A compiled lexicon, read in place from a buffer or a mapped file."""

    def __init__(self, data):
        root, *tables, labels, self.finals = _unpacked(data)
        (self.root,) = root.cast("I")
        self.first, self.targets, self.skips, self.starts, self.ids = (t.cast("I") for t in tables)
        self.labels = bytes(labels)

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word, or None if the lexicon lacks it."""
        state, number, labels, first = self.root, 0, self.labels, self.first
        for c in word:
            edge = labels.find(c, first[state], first[state + 1])
            if edge < 0:
                return None
            number += self.skips[edge]
            state = self.targets[edge]
        if not self.finals[state]:
            return None
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()

    @functools.cached_property
    def _arrays(self) -> tuple[np.ndarray, ...]:
        """State and label of every edge in one number, in order, with one more that stands for none; targets, skips, finals."""
        sources = np.repeat(np.arange(len(self.finals)), np.diff(np.asarray(self.first).astype(np.int64)))
        edges = np.append(sources << 8 | np.frombuffer(self.labels, np.uint8), np.iinfo(np.int64).max)
        return edges, np.asarray(self.targets), np.asarray(self.skips), np.frombuffer(self.finals, np.bool_)

    def find_many(self, words: list[bytes]) -> list[list[int] | None]:
        """As ``find`` of each word, with a step of all words at once."""
        edges, targets, skips, finals = self._arrays
        sizes, raw = np.fromiter(map(len, words), np.int64), np.frombuffer(b"".join(words), np.uint8)
        begins, states, numbers = np.cumsum(sizes) - sizes, np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        going, step = np.flatnonzero(sizes), 0
        while going.size:
            wanted = states[going] << 8 | raw[begins[going] + step]
            edge = np.searchsorted(edges, wanted)
            there = edges[edge] == wanted
            states[going[~there]] = -1
            going, edge, step = going[there], edge[there], step + 1
            states[going] = targets[edge]
            numbers[going] += skips[edge]
            going = going[sizes[going] > step]
        found: list[list[int] | None] = [None] * len(words)
        for i in np.flatnonzero((states >= 0) & finals[states]).tolist():
            number = numbers[i]
            found[i] = self.ids[self.starts[number] : self.starts[number + 1]].tolist()
        return found


class _Odd(Exception):
    """A word has characters that the library and Python treat apart."""


class _Pieces(dict):
    """Word to ids. A new word has an empty list, which ``settle`` fills; words of the lexicon stay, others go once there are many."""

    def __init__(self, merges: Merges, lexicon: Lexicon):
        super().__init__()
        self.merges, self.lexicon = merges, lexicon
        self.new: list[str] = []
        self.rare: list[str] = []

    def find(self, word: str) -> list[int]:
        raw = word.encode()
        ids = self.lexicon.find(raw)
        return self.merges.encode(raw) if ids is None else ids

    def __missing__(self, word: str) -> list[int]:
        if not word.isascii() and _ODD.search(word):
            raise _Odd
        self.new.append(word)
        self[word] = ids = []
        return ids

    def settle(self) -> None:
        """Finds or merges all new words together."""
        raw = [w.encode() for w in self.new]
        found = self.lexicon.find_many(raw)
        lacking = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(lacking, self.merges.encode_many([raw[i] for i in lacking]), strict=True):
            found[i] = ids
        for word, ids in zip(self.new, found, strict=True):
            self[word] += ids
        self.rare += [self.new[i] for i in lacking]
        self.new.clear()
        if len(self.rare) > _KEPT:
            for word in self.rare:
                del self[word]
            self.rare.clear()


@contextlib.contextmanager
def _uncollected() -> Iterator[None]:
    """Without the search for reference cycles, which takes a tenth of the time here and finds none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Codec:
    """Encodes and decodes texts with the tables of one compiled file."""

    def __init__(self, data):
        lexicon, pairs, made, units, ends, names, special = _unpacked(data)
        self.pieces = _Pieces(Merges(pairs.cast("Q"), made.cast("I").tolist(), units.cast("I").tolist()), Lexicon(lexicon))
        ends = [0, *ends.cast("I")]
        #: the token of each id, None where there is none, and the id in decimal
        self.names = [bytes(names[a:b]) or None for a, b in zip(ends, ends[1:], strict=False)]
        self.numbers = [b"%d" % i for i in range(len(self.names))]
        self.special: dict[str, int] = json.loads(bytes(special))
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    @classmethod
    def open(cls, path: str) -> Codec:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def _plain(self, text: str) -> list[list[int]]:
        """The ids of the words of a text without special tokens; those of new words come when the words are settled."""
        words, get = pretokens(text), self.pieces.__getitem__
        try:
            if len(words) <= _BLOCK:
                return list(map(get, words))
            ids: list[int] = []
            for at in range(0, len(words), _BLOCK):
                some = list(map(get, words[at : at + _BLOCK]))
                self.pieces.settle()
                ids += chain.from_iterable(some)
            return [ids]
        except _Odd:
            return list(map(self.pieces.find, exact_pretokens(text)))

    def _pieces_of(self, text: str) -> list[list[int]]:
        if not (self.cut and "<" in text):
            return self._plain(text)
        found, at = [], 0
        for m in self.cut.finditer(text):
            found += self._plain(text[at : m.start()])
            found.append([self.special[m[0]]])
            at = m.end()
        return found + self._plain(text[at:])

    def encode_many(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """The ids of each text; the new words of all are looked up and merged together."""
        found = list(map(self._pieces_of, texts))
        self.pieces.settle()
        for pieces in found:
            yield list(chain.from_iterable(pieces))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_many([text]))

    def written(self, ids: Iterable[int]) -> bytes:
        """The ids in decimal, joined by single spaces."""
        return b" ".join(map(self.numbers.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        """The ids' tokens joined by single spaces, as for a tokenizer without a decoder; unknown ids are left out."""
        try:
            return b" ".join(map(self.names.__getitem__, ids))
        except (IndexError, TypeError):
            return b" ".join(n for i in ids if 0 <= i < len(self.names) and (n := self.names[i]) is not None)


def frequent_words(docs: DataFrame, k: int = 50_000) -> list[str]:
    """The most frequent words of the whole corpus, at most ``k``: all those above the lowest level that so many reach.

    Levels are eighths of powers of two of the count. Only the number of words of each level and the chosen words reach
    the driver. Words that occur once are never among them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for whole in batches:
            for batch in slices(whole, limit=1 << 20):
                with _uncollected():
                    for text in batch.column("text").to_pylist():
                        counts.update(pretokens(text or ""))
                if len(counts) > _COUNTED:
                    yield flush()
        yield flush()

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "word string, n long")
    counted = rows.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").select("word", F.floor(F.log2("n") * 8).cast("int").alias("level"))
    counted, total, least = materialize(counted, "word-levels"), 0, None
    for r in sorted(counted.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        total += r["count"]
        if total > k:
            break
        least = r["level"]
    found = [] if least is None else [r["word"] for r in counted.where(F.col("level") >= least).select("word").collect()]
    release(counted)
    return found


def compiled(vocabulary: Vocabulary, words: Iterable[str]) -> bytes:
    """The file of a codec: a lexicon of the words and of all whole words of the vocabulary, merges and tokens."""
    back = {c: b for b, c in enumerate(byte_characters())}
    entries = {}
    for token, i in vocabulary.ids.items():
        if token.endswith(END) and len(token) > len(END):
            raw = bytes(back[c] for c in token[: -len(END)])
            if vocabulary.merges.encode(raw) == [i]:
                entries[raw] = [i]
    raw = [w.encode() for w in words]
    entries |= zip(raw, vocabulary.merges.encode_many(raw), strict=True)
    names = [vocabulary.tokens.get(i, "").encode() for i in range(max(vocabulary.tokens) + 1)]
    tables = [(vocabulary.pairs, np.uint64), (vocabulary.made, np.uint32), (vocabulary.units, np.uint32), (np.cumsum([len(n) for n in names]), np.uint32)]
    return _packed(compile_lexicon(entries), *(np.array(x).astype(kind).tobytes() for x, kind in tables), b"".join(names), json.dumps(vocabulary.special).encode())


_opened: dict[str, Codec] = {}


def _codec(name: str) -> Codec:
    """The codec of a distributed file, which a worker keeps until its task ends."""
    if name not in _opened:
        _opened.clear()
        _opened[name] = Codec.open(SparkFiles.get(name))
    return _opened[name]


def _close() -> None:
    _opened.clear()


def distribute(docs: DataFrame, vocabulary: str, k: int = 50_000) -> str:
    """Compiles a codec for the corpus, writes it to the shared folder and hands it to all executors; its name there."""
    spark, name = docs.sparkSession, f"codec-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(shared_file(spark, name, compiled(Vocabulary(vocabulary), frequent_words(docs, k))))
    return name


def encode_documents(docs: DataFrame, vocabulary: str, k: int = 50_000) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row of ``docs`` (doc_id, text); ids joined by a space, as bytes.

    Null and empty texts have no ids. Strings of special tokens in a text become their ids. Repeated rows stay, other
    columns are ignored.
    """
    return _encoded(docs, vocabulary, k, "ids binary, decoded binary", lambda ids, decoded: (ids, decoded))


def _few(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _encoded(docs: DataFrame, vocabulary: str, k: int, schema: str, finish) -> DataFrame:
    """doc_id, n_tokens and what ``finish`` makes of the written ids and of the text decoded from the ids."""
    name, kinds = distribute(docs, vocabulary, k), [pa.binary() if "binary" in c else pa.string() for c in schema.split(", ")]
    names = ["doc_id", "n_tokens", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name)
        for whole in batches:
            for batch in slices(whole, limit=1 << 20):
                counts, rows = [], []
                with _uncollected():
                    for ids in codec.encode_many(text or "" for text in batch.column("text").to_pylist()):
                        counts.append(len(ids))
                        rows.append(finish(codec.written(ids), codec.decode(ids)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return _few(docs).mapInArrow(tidied(run, _close), f"doc_id long, n_tokens long, {schema}")


def token_digests(docs: DataFrame, vocabulary: str, k: int = 50_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encode_documents, digested before they leave the worker."""
    digests = lambda ids, decoded: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
    return _encoded(docs, vocabulary, k, "ids_sha256 string, decoded_sha256 string", digests)


def default_vocabulary() -> str:
    """The public 49k word-end vocabulary of the machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("word_bpe_49k.json"))


def op5_bpe(spark, sf_dir):
    from .common import documents

    return token_digests(documents(spark, sf_dir), default_vocabulary())
