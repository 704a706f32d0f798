"""Operators on nulls, repeated rows, ties, very long texts and clashing columns, against plain versions."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest

from palisade.llm import licenses, media, mixing, pii, rules, sharding

KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(re.sub("[ -]", "", x)) <= 19 and _luhn(re.sub("[ -]", "", x))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.findall("[0-9]", x)) <= 15),
}


def _luhn(x):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(x))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def _base(text):
    found = [(m.start(), k, m.end()) for k, (_, (rule, good)) in enumerate(KINDS.items()) for m in re.finditer(rule, text) if good(m[0])]
    return [(list(KINDS)[k], s, e) for s, k, e in sorted(found)]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(12)
    some = ["the", "under the MIT license", "a.b@c.de", "10.0.0.1", "4111 1111 1111 1111", "+44 171 555 2028", "apache license, version 2", "cc-by-nc", "é", "99", "\n", "  "]
    texts = [None, "", " \n", "x", "y" * 64, "z" * 192, "w" * 10_000, "é" * 7000 + " 1" * 9000, "q " * 60_000, "same", "same", "same"]
    texts += ["many copies"] * 60 + [" ".join(r.choice(some) for _ in range(r.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, None, f"s{i % 3}", 1, "c") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "no id", None, None, 2, "d"), (None, None, None, None, 3, "e")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int, key string")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_media_values(docs, rows):
    want = collections.Counter()
    for i, t in rows:
        raw = t.encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    got = media.text_media(docs).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    for i, t in rows[:12]:
        stored = b"".join(x for _, _, x in media.npy_tiles(media.decode(media.text_as_image(t.encode())), media.TILE, media.WIDTH))
        assert {(r.media_bytes, r.media_sha256) for r in got if r.doc_id == i} == {(len(stored), hashlib.sha256(stored).hexdigest())}
        assert np.concatenate(media.read_npy_files(stored)).tobytes().startswith(t.encode())


def test_media_tiles_of_broken_files(spark):
    grey = np.arange(600, dtype=np.uint8).reshape(20, 30)
    broken = [None, b"", b"P2 1 1 255 x", b"P2 " + b"9" * 5000 + b" 1 255 1", b"P2 2 1 255 300 1", b"P2 2 1 255 -1 1", b"P2 2 1 9 8 10", b"BM" + bytes(60), b"P7 1 1"]
    bmp = bytearray(media.encode_bmp(np.zeros((2, 4, 3), np.uint8)))
    bmp[28:30] = b"\x08\x00"  # eight bits a pixel, but no palette
    files = [*broken, bytes(bmp), media.encode_pgm(grey), media.encode_bmp(np.dstack([grey] * 3))]
    table = spark.createDataFrame(list(enumerate(files)), "name int, data binary")
    found = media.media_tiles(table, "name", "data", tile=16).collect()
    assert {r.key for r in found if r.error} == set(range(len(broken) + 1)) and all((r.tile is None) == (r.error is not None) for r in found)
    for k in (len(files) - 2, len(files) - 1):
        image = media.read_npy_tiles([(r.tile_row, r.tile_col, bytes(r.tile)) for r in found if r.key == k])
        assert (image == media.decode(files[k])).all()
    small = media.media_tiles(table.where("name = 10"), "name", "data", 5, 10).first()
    assert (np.load(io.BytesIO(small.tile)) == np.round(grey.reshape(5, 4, 10, 3).mean(axis=(1, 3)))).all()


def test_personal_data_by_the_given_patterns(docs, rows):
    want = collections.Counter()
    for i, t in rows:
        spans = _base(t)
        kinds = collections.Counter(k for k, _, _ in spans)
        want[i, *(kinds[k] for k in KINDS), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()] += 1
    got = pii.scan_pii(docs).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    assert all({f"{k}:{s}:{e}" for k, s, e in _base(t)} <= set(r.spans.split(",")) for (i, t) in rows for r in got if r.doc_id == i and _base(t) and i is not None)
    r = random.Random(3)
    for _ in range(5000):
        text = "".join(r.choice("0123456789" * 2 + "ab.@+- ()\n%_é") for _ in range(r.randint(0, 60)))
        assert pii.base_spans(text) == _base(text), text


def test_spans_are_found_wherever_they_stand():
    key = "a1b2c3d4e5" * 4
    for n in (0, 1000, 1015, 1020, 5000):
        text = f"{'1 ' * n}\n token = \"{key}\" end"
        assert ("secret", text.index(key), text.index(key) + 40) in pii.find_spans(text, pii.trained())[1], n
    plain = "x" * 30 + " 12 " * 3000
    whole = pii.find_spans(plain + f'token = "{key}"', pii.trained())[1]
    assert [k for k, _, _ in whole] == ["secret"]


def test_field_finds_what_sentences_hide():
    right = total = 0
    for text, gold in pii.sentences(300, seed=1234):
        found = {(k, s, e) for k, s, e in pii.find_spans(text, pii.trained())[1]}
        right, total = right + len(found & set(gold)), total + len(gold)
    assert right >= 0.9 * total


def test_repeated_words_whatever_the_hashes(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    texts = [[r.choice("abcdefgh") for _ in range(n)] for n in (0, 1, 2, 3, 4, 20, 60, 300)] + [["a"] * 9, list("abcabcxyz"), list("abcdefghij")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, words array<string>").withColumn("n", F.size("words"))
    for bits in (21, 62, 3):  # 62 leaves two bits of the hash, 3 leaves no room for places
        got = {x.doc_id: x.n_repeat_words for x in rules._with_repeated_words(df, bits).collect()}
        for k, w in enumerate(texts):
            seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            assert got[k] == len({i + d for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for d in range(3)}), (bits, k)


def test_shards(spark, docs, rows):
    found = sharding.balanced_shards(docs, 7).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, sharding.balanced_shards(docs, 7, cell_rows=2).collect()), key=str)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in found) == collections.Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows)
    counts = collections.Counter(r.shard for r in found)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(n)) for s, n in counts.items())
    # links between equal texts that are cut: far fewer than by chance
    text, links, cut = dict(rows), 0, 0
    groups = collections.defaultdict(list)
    for r in found:
        if r.doc_id is not None and text[r.doc_id]:
            groups[text[r.doc_id]].append(r.shard)
    for g in groups.values():
        links += len(g) * (len(g) - 1) // 2
        cut += len(g) * (len(g) - 1) // 2 - sum(n * (n - 1) // 2 for n in collections.Counter(g).values())
    assert cut < 0.75 * links  # one group is three times what a shard may hold


def test_mix_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "w " * (1 + k % 4), None, k) for k in range(200)], "doc_id long, text string, source string, row int")
    copies = mixing.mix(docs).collect()
    taken = collections.Counter(r.row for r in mixing.mixed_documents(docs).collect())
    assert sum(taken.values()) == sum(r.copies for r in copies) == 200 and max(taken.values()) <= 3


def test_license_rows(docs, rows):
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(docs).collect())
    want = collections.Counter()
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        hits = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in hits]
        want[i, len(words), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))] += 1
    assert got == want
