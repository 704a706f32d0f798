"""Personal data by a semi-Markov conditional random field over candidate segments.

Around digits and at signs a text is cut into atoms (words, single marks, gaps). Whole candidate segments of at most
``LONGEST`` atoms are scored by features of the segment as one piece, and dynamic programming chooses boundaries and
types together. The weights are learnt by conditional likelihood on sentences made by rule. Spans of the contract's
patterns are candidates like all others and are kept in any case; the field adds secrets, IBANs and social security
numbers, which no pattern alone decides.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "ssn")
LONGEST, AHEAD = 24, 512
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive runs and a look-behind keep these linear; a match never starts inside a run of digits
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: for each at sign the longest local part after the last match."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            free = match.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _ip_parts(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the contract's patterns, by start and kind."""
    found = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if _ip_parts(m[0])]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0]), s[2]))


# --- segments -------------------------------------------------------------------------------------------------

_ATOM = re.compile(r"[A-Za-z0-9_]+|\s+|.", re.S)
_SEED = re.compile(r"[0-9@]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SPACED = re.compile(r"[0-9A-Z ().+-]+")
_HEX = re.compile(r"[0-9a-fA-F]+")
_KEYWORD = re.compile(r"(?i)(?:token|secret|key|passw\w*|auth|credential)\w*\W{0,6}$")
_SSN_WORD = re.compile(r"(?i)(?:ssn|social|security)\W+(?:\w+\W+)?$")
N_FEATURES = 24


def _token(text: str, at: int, step: int, stop: int) -> int:
    """From ``at``, backwards or forwards to the edge of the run of non-blank characters, ``stop`` at the furthest."""
    if step < 0:
        while at > stop and not text[at - 1].isspace():
            at -= 1
    else:
        while at < stop and not text[at].isspace():
            at += 1
    return at


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that hold all segments there can be: runs of whole words with a digit or at sign, and, beyond single
    spaces, of more such words and of words that a spaced number may have."""
    done = 0
    for m in _SEED.finditer(text):
        if m.start() < done:
            continue
        start, end = _token(text, m.start(), -1, done), _token(text, m.end(), 1, len(text))
        while start - 2 >= done and text[start - 1] == " " and _SPACED.fullmatch(text, at := _token(text, start - 1, -1, done), start - 1):
            start = at
        while text[end : end + 1] == " ":
            to = _token(text, end + 1, 1, len(text))
            if to == end + 1 or not (_SEED.search(text, end + 1, to) or _SPACED.fullmatch(text, end + 1, to)):
                break
            end = to
        yield start, end
        done = end


def segment_features(text: str, s: int, e: int) -> list[float]:
    """Features of text[s:e] as one piece, with what stands beside it."""
    x = text[s:e]
    digits = sum(c.isdigit() for c in x)
    number = "".join(c for c in x if c.isdigit())
    spaced, before = " " in x, text[max(0, s - 24) : s]
    prev, after = text[s - 1 : s], text[e : e + 1]
    hexa, word = bool(_HEX.fullmatch(x)), x.isalnum()
    mixed = word and 0 < digits < len(x)
    plain = not x.strip("0123456789 -")
    iban = bool(_IBAN.fullmatch(x))
    if iban:
        y = x.replace(" ", "")
        check = int("".join(str(int(c, 36)) for c in y[4:] + y[:4])) % 97 == 1
    ip = bool(_IP.fullmatch(x))
    return [
        1.0, float(bool(_EMAIL.fullmatch(x))), float(ip and _ip_parts(x)), float(ip and not _ip_parts(x)),
        float(plain and 12 <= digits <= 19 and luhn(number)), float(plain and 12 <= digits <= 19 and not luhn(number)),
        float(bool(_PHONE.fullmatch(x)) and 9 <= digits <= 15), float(x[0] == "+" and not 9 <= digits <= 15),
        float(hexa and len(x) >= 16), float(mixed and len(x) >= 12), float(bool(_KEYWORD.search(before))),
        float(bool(_KEYWORD.search(before)) and word and len(x) >= 8), float(prev in "\"'" and prev == after and prev != ""),
        float(iban), float(iban and check), float(bool(_SSN.fullmatch(x))), float(bool(_SSN_WORD.search(before))),
        float(spaced), float(prev.isalnum() or after.isalnum()), float(prev in "+.-@(" and prev != "") + float(after in "@-" and after != ""),
        math.log(len(x)), digits / len(x), float(word and not digits), float(digits == len(x)),
    ]


def _atoms(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(text, start, end)]


def _segments(text: str, atoms: list[tuple[int, int]], first: int, last: int) -> list[tuple[int, int, int, int]]:
    """Candidate segments (first atom, last atom + 1, start, end) that start at atoms ``first`` to ``last`` - 1."""
    out = []
    for i in range(first, last):
        s = atoms[i][0]
        if not (text[s].isascii() and (text[s].isalnum() or text[s] == "+")):
            continue
        rich = space = False
        for j in range(i, min(len(atoms), i + LONGEST)):
            a, b = atoms[j]
            piece = text[a:b]
            if piece.isspace():
                if piece != " ":
                    break
                space = True
            rich = rich or piece == "@" or not piece.isalpha() and bool(_DIGITS.search(piece))
            if space and not _SPACED.fullmatch(text, s, b):
                break
            if rich and piece[-1].isalnum() and b - s >= 7:
                out.append((i, j + 1, s, b))
    return out


def candidates(text: str, start: int, end: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Number of atoms of a stretch and all its candidate segments."""
    atoms = _atoms(text, start, end)
    return len(atoms), _segments(text, atoms, 0, len(atoms))


class SemiCRF:
    """Weights (kinds x features) over candidate segments; an atom outside all segments scores 0."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def decode(self, text: str, start: int, end: int) -> list[tuple[str, int, int]]:
        """The best segmentation of a stretch of any length; segments are scored ``AHEAD`` atoms at a time."""
        atoms = _atoms(text, start, end)
        n = len(atoms)
        value, back = [0.0] * (n + 1), [None] * (n + 1)  # back: (first atom, kind) of the segment that ends here
        for at in range(0, n, AHEAD):
            spans = _segments(text, atoms, at, min(n, at + AHEAD))
            scores = np.array([segment_features(text, s, e) for _, _, s, e in spans]).reshape(-1, N_FEATURES) @ self.weights.T
            found = zip(spans, scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist(), strict=True)
            good = {}
            for (i, j, _, _), kind, score in found:
                if score > 0:
                    good.setdefault(i, []).append((j, kind, score))
            for i in range(at, min(n, at + AHEAD)):  # what ends up to here is settled
                for j, kind, score in good.get(i, ()):
                    if value[i] + score > value[j]:
                        value[j], back[j] = value[i] + score, (i, kind)
                if value[i] >= value[i + 1]:
                    value[i + 1], back[i + 1] = value[i], None
        found, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind = back[j]
                found.append((KINDS[kind], atoms[i][0], atoms[j - 1][1]))
                j = i
        return found[::-1]


def _lattice(text: str, gold: list[tuple[str, int, int]]):
    n, spans = candidates(text, 0, len(text))
    want = {(s, e): KINDS.index(k) for k, s, e in gold}
    x = np.array([segment_features(text, s, e) for _, _, s, e in spans]).reshape(-1, N_FEATURES)
    y = np.zeros((len(spans), len(KINDS)))
    for k, (_, _, s, e) in enumerate(spans):
        if (s, e) in want:
            y[k, want[s, e]] = 1
    return n, spans, x, y


def _expected(n: int, spans, scores: np.ndarray) -> np.ndarray:
    """Marginal probability of each (segment, kind): forward and backward sums over segmentations."""
    total = np.logaddexp.reduce(scores, axis=1)
    ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = back[n] = 0.0
    ending, starting = {}, {}
    for k, (i, j, _, _) in enumerate(spans):
        ending.setdefault(j, []).append((i, total[k]))
        starting.setdefault(i, []).append((j, total[k]))
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + t for i, t in ending.get(j, ()))])
        i = n - j
        back[i] = np.logaddexp.reduce([back[i + 1], *(back[q] + t for q, t in starting.get(i, ()))])
    ends = np.array([(i, j) for i, j, _, _ in spans])
    return np.exp(scores + (ahead[ends[:, 0]] + back[ends[:, 1]] - ahead[n])[:, None])


def sentences(n: int, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Made-up sentences with their spans: each kind, and things that look alike but are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card(good: bool) -> str:
        x = digits(r.choice((12, 13, 15, 16, 16, 19)) - 1)
        last = next(d for d in "0123456789" if luhn(x + d) == good)
        x += last
        return x if r.random() < 0.6 else r.choice(" -").join(x[i : i + 4] for i in range(0, len(x), 4))

    def iban() -> str:
        body = digits(r.randint(12, 20))
        country = r.choice(("DE", "FR", "ES", "GB"))
        rest = int(body + "".join(str(int(c, 36)) for c in country) + "00")
        return f"{country}{98 - rest % 97:02d}{body}"

    alnum = lambda k, a: "".join(r.choice(a) for _ in range(k))
    hexa, wide = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    made = {
        "email": lambda: ("", f"{word()}{r.choice(('.', '_', ''))}{digits(2)}@{word()}{r.choice(('', '7'))}.{r.choice(('com', 'org', 'example.com'))}", ""),
        "ip": lambda: ("", ".".join(str(r.randint(0, 255)) for _ in range(4)), ""),
        "card": lambda: ("", card(True), ""),
        "phone": lambda: ("", r.choice((f"+1 ({digits(3)}) 555-{digits(4)}", f"+{r.randint(20, 99)} {digits(3)} {digits(3)} {digits(3)}", f"+{digits(11)}")), ""),
        "secret": lambda: r.choice((("token = \"", alnum(40, hexa), '"'), ("api_key: ", alnum(r.randint(16, 40), wide), ""), ("secret='", alnum(32, wide), "'"), ("password=", alnum(12, wide) + "7", ""))),
        "iban": lambda: ("", iban(), ""),
        "ssn": lambda: (r.choice(("ssn ", "social security ", "")), f"{digits(3)}-{digits(2)}-{digits(4)}", ""),
        "": lambda: ("", r.choice((digits(r.randint(1, 8)), f"{digits(2)}.{digits(2)}", f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", card(False), ".".join(str(r.randint(256, 999)) for _ in range(4)), f"id {digits(6)}", f"{word()}{digits(3)}", f"+{digits(4)}", f"{digits(3)}-{digits(4)}", f"file {alnum(9, hexa)}.txt", f"page {digits(10)}")), ""),
    }
    out = []
    for i in range(n):
        text, gold = " ".join(word() for _ in range(r.randint(0, 3))), []
        for _ in range(r.randint(1, 2)):
            kind = r.choice((*KINDS, "", ""))
            before, body, after = made[kind]()
            text += (" " if text else "") + before
            if kind and (kind != "secret" or any(c.isdigit() for c in body)):
                gold.append((kind, len(text), len(text) + len(body)))
            text += body + after + r.choice(("", ".", ",", "")) + " " + " ".join(word() for _ in range(r.randint(1, 3)))
        out.append((text, gold))
    return out


@functools.lru_cache(maxsize=2)
def trained(n: int = 500, steps: int = 60, rate: float = 0.5, l2: float = 1e-3) -> SemiCRF:
    """Fits the weights by gradient ascent (with per-weight step sizes) on the conditional likelihood."""
    data = [d for d in (_lattice(t, g) for t, g in sentences(n)) if d[1]]
    w, seen = np.zeros((len(KINDS), N_FEATURES)), np.full((len(KINDS), N_FEATURES), 1e-6)
    w[:, 0] = -2.0
    for _ in range(steps):
        grad = -l2 * len(data) * w
        for m, spans, x, y in data:
            grad += (y - _expected(m, spans, x @ w.T)).T @ x
        seen += grad**2
        w = w + rate * grad / np.sqrt(seen)
    return SemiCRF(w)


def find_spans(text: str, model: SemiCRF) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all spans: the base ones and what the field finds besides; by start, kind and end.

    What the field finds goes only if it lies wholly inside one base span.
    """
    base = base_spans(text)
    every = set(base)
    # starts of the base spans, and how far those up to each start reach
    starts, reach = sorted(s for _, s, _ in base), list(accumulate((e for _, _, e in sorted(base, key=lambda x: x[1])), max))
    for start, end in regions(text):
        for kind, s, e in model.decode(text, start, end):
            k = bisect_right(starts, s)
            if kind not in BASE and not (k and reach[k - 1] >= e):
                every.add((kind, s, e))
    return base, sorted(every, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_pii(docs: DataFrame, model: SemiCRF | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of ``docs`` (doc_id, text).

    Counts and base_sha256 are those of the contract's patterns, spans also has what the field adds. Null texts count
    as empty: no spans, the digest of nothing. Whole texts are scanned; other columns are ignored.
    """
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (*[pa.int64()] * 4, pa.string(), pa.string())
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for text in batch.column("text").to_pylist():
                    base, every = find_spans(text or "", model)
                    kinds = [k for k, _, _ in base]
                    rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, model: SemiCRF) -> str:
    """The text with each span replaced by its kind in angle brackets; where spans overlap, their union by the first."""
    out, at = [], 0
    for kind, s, e in find_spans(text, model)[1]:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, model: SemiCRF | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars``, if there, made to fit; null texts stay null."""
    model = model or trained()

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([texts], ["text"])
        return pa.array([None if t is None else masked(t, model) for b in slices(whole) for t in b.column("text").to_pylist()], pa.string())

    out = docs.withColumn("text", mask(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op7_pii(spark, sf_dir):
    from .common import documents

    return scan_pii(documents(spark, sf_dir))
