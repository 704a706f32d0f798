import collections
import io
import random
import re

import numpy as np
import pytest

from palisade.llm import bpe, licenses, media, mixing, pii, quality, rules, sharding, simhash, substring

ROWS = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, anchor string, mark string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    vocab = ["the", "of", "in", "and", "thin", "Ér", "ß", "x1", "a@b.co", "10.0.0.1", "under", "mit", "license", "##"]
    words = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, long_ = words(70), words(3000)
    texts = [None, "", "  \n\t", "one", "two words", shared, shared, f"{words(30)} {shared} {words(9)}", long_, long_ + " end", f"{words(60)}\n{shared}", "the same " * 60, "the same " * 60, "under the MIT license", *(words(r.randint(1, 120)) for _ in range(40))]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, 0, 1, 2, "a", "b", "c") for i, t in enumerate(texts)]
    rows += [rows[7], (None, "no id", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ROWS)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_simhash(docs, rows):
    found = collections.Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = np.array([simhash.fingerprint(t.encode()) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.arange(len(rows))
    while True:
        new = np.where(near, label[None, :], len(rows)).min(axis=1)
        if (new == label).all():
            break
        label = new
    low = {k: min((i for (i, _), x in zip(rows, label, strict=True) if x == k and i is not None), default=None) for k in set(label)}
    assert found == collections.Counter((i, int(p.astype(np.int64)), low[k]) for (i, _), p, k in zip(rows, prints, label, strict=True))


def test_deduplicate_keeps_one_row_of_each_component(spark, docs, rows):
    more = spark.createDataFrame([(5, "another text under an id that is used"), (None, "a first text without any id"), (None, "a second one that has none either"), (None, None)], "doc_id long, text string")
    every = docs.select("doc_id", "text", "fp").unionByName(more, allowMissingColumns=True)
    texts = [(i, t or "") for i, t in ((r.doc_id, r.text) for r in every.collect())]
    prints = np.array([simhash.fingerprint(t.encode(), 5) for _, t in texts], np.uint64)
    near, label = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3, np.arange(len(texts))
    while not (label == (new := np.where(near, label[None, :], len(texts)).min(axis=1))).all():
        label = new
    groups = [[texts[k] for k in np.flatnonzero(label == g)] for g in sorted(set(label.tolist()))]
    got = simhash.deduplicate(every, width=5)
    assert got.columns == every.columns
    left = [(r.doc_id, r.text or "") for r in got.collect()]
    assert len(left) == len(groups)
    for group in groups:
        least = min((i for i, _ in group if i is not None), default=None)
        assert sum(x in left for x in set(group) if x[0] == least) == 1


def test_links_lose_none_even_when_anchors_are_dealt(spark):
    r = random.Random(2)
    values = {r.getrandbits(64) for _ in range(50)}
    values |= {v ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))) for v in list(values) for _ in range(6)}
    values = np.array(sorted(values), np.uint64)
    distinct = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    want, label = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3, np.arange(len(values))
    while not (label == (new := np.where(want, label[None, :], len(values)).min(axis=1))).all():
        label = new
    for block in (2048, 1):
        parts = {x.node: x.root for x in simhash.connected_components(simhash.links(distinct, block=block)).collect()}
        groups = collections.defaultdict(set)
        for v, k in zip(values.view(np.int64).tolist(), label.tolist(), strict=True):
            groups[k].add(parts.get(v, v))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_substring(docs, rows):
    first, want = {}, collections.Counter()
    texts = [(i, t.encode().split()) for i, t in rows]
    for i, w in sorted((x for x in texts if x[0] is not None), key=lambda x: x[0]):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in texts:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49 if i is not None else 0):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = True
        want[i, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    for batches in (1, 2, 3, 5):
        got = collections.Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in substring.deduplicate_substrings(docs, batches).collect())
        assert got == want


def test_rules(docs, rows):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules.judge(docs).collect())
    want = collections.Counter()
    for i, t in rows:
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)] += 1
    assert got == want


def test_sharding_and_mixing(docs, rows):
    shards = sharding.balanced_shards(docs, 7).collect()
    sizes = collections.Counter(r.shard for r in shards)
    assert len(shards) == len(rows) and max(sizes.values()) - min(sizes[s] for s in range(7)) <= 1
    assert all(sorted(r.slot for r in shards if r.shard == s) == list(range(n)) for s, n in sizes.items())
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows) and all(0 <= r.copies <= 3 for r in mixed)
    assert abs(sum({r.source: r.target for r in mixed}.values()) - sum({r.source: r.source_size for r in mixed}.values())) < 1e-6
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mix(docs).collect()))
    clash = docs.withColumnsRenamed({"fp": "copies", "anchor": "turn", "mark": "row", "score": "id"})
    taken = mixing.mixed_documents(clash)
    assert taken.columns == clash.columns
    assert collections.Counter(r.doc_id for r in taken.collect()) == +collections.Counter({i: sum(r.copies for r in mixed if r.doc_id == i) for i in {r.doc_id for r in mixed}})
    # pieces of large groups may be as small as wished
    cut = sharding.balanced_shards(docs.unionByName(docs), 7, cell_rows=3).collect()
    sizes = collections.Counter(r.shard for r in cut)
    assert len(cut) == 2 * len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    assert len({(r.shard, r.slot) for r in cut}) == len(cut)


def test_bpe(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    got = collections.Counter((r.doc_id, bytes(r.ids).decode(), bytes(r.decoded).decode()) for r in bpe.encode_documents(docs, bpe.default_vocabulary(), 20).collect())
    ids = [(i, library.encode(t, add_special_tokens=False).ids) for i, t in rows]
    assert got == collections.Counter((i, " ".join(map(str, x)), library.decode(x, skip_special_tokens=False)) for i, x in ids)


def test_lexicon_and_long_words():
    entries = {w.encode(): [k, k + 1][: 1 + k % 2] for k, w in enumerate(["a", "ab", "abc", "bc", "xbc", "zebra"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    assert all(lexicon.find(w) == ids for w, ids in entries.items()) and lexicon.find(b"abcd") is None and lexicon.find(b"") is None
    v = bpe.Vocabulary(bpe.default_vocabulary()).merges
    r = random.Random(4)
    for n in (1, 41, 500):
        parts = [v.inner[b] for b in "".join(r.choice("abcdethin") for _ in range(n)).encode()]
        assert v._merge_long(list(parts)) == v._merge_short(list(parts))


def test_pii_base_patterns_and_field():
    text = 'x +1 (171) 555-2028 a.b@c.de@f.org 1.2.3.4.5.6.7.8 300.1.1.1 pay 4111-1111 1111 1111 token = "0123456789abcdef0123456789abcdef01234567" end'
    base, every = pii.find_spans(text, pii.trained())
    assert [k for k, _, _ in base] == ["phone", "email", "ip", "ip", "card"] and {k for k, _, _ in every} >= {"secret"} and set(base) <= set(every)
    assert "<secret>" in pii.masked(text, pii.trained()) and pii.find_spans("", pii.trained()) == ([], [])
    assert len(pii.base_spans("1" * 50_000 + "@" * 50_000)) == 0  # linear
    right = total = 0
    for sentence, gold in pii.sentences(200, seed=99):
        found = {s for a, b in pii.regions(sentence) for s in pii.trained().decode(sentence, a, b)}
        right, total = right + len(found & set(gold)), total + len(gold)
    assert right > 0.85 * total


def test_licenses():
    scanner = licenses.Scanner({})
    words = licenses.tokens(b"so, UNDER the\nMIT-License and cc.by.nc under the mit license")
    assert scanner.scan(words)[:2] == ([1, 6, 9], {"mit", "cc-by-nc"})
    notice = "x " * 200 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    assert scanner.scan(licenses.tokens(notice.encode()))[2] == {"mit"} and scanner.scan([])[3] == 0.0


def test_media():
    r = np.random.default_rng(0)
    grey, colour = r.integers(0, 256, (37, 50), np.uint8), r.integers(0, 256, (9, 7, 3), np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P3 # c\n1 1 255 1 2 3") == [[[1, 2, 3]]]).all() and (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    assert np.allclose(media.area_resize(grey.astype(float), 37, 25), grey.reshape(37, 25, 2).mean(axis=2)) and np.isclose(media.area_resize(grey, 1, 1), grey.mean()).all()
    assert (media.read_npy_tiles(list(media.npy_tiles(grey, 16, 16))) == grey).all() and np.load(io.BytesIO(next(media.npy_tiles(grey))[2])).shape == (37, 50)
    for broken in (b"", b"P5 2 2 255\n1", b"BM", b"P5 0 1 255 "):
        with pytest.raises(media.MediaError):
            media.decode(broken)


def test_empty_tables_and_quality(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    scored = quality.classify(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.classify(docs, labels.limit(0)).collect())
    frames = [quality.classify(none, labels), simhash.near_duplicates(none), media.text_media(none), sharding.balanced_shards(none), rules.judge(none), pii.scan_pii(none), licenses.scan_licenses(none), mixing.mix(none), substring.deduplicate_substrings(none), bpe.encode_documents(none, bpe.default_vocabulary(), 5)]
    assert [f.count() for f in frames] == [0] * 10
