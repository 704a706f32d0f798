"""Encoding and decoding against the tokenizers library, over all of Unicode."""

import random

import pytest

from palisade.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.compiled(bpe.Vocabulary(bpe.default_vocabulary()), ["thin", "Ér", "naïveté", "zzxqy", "\U00010d50x"]))


def _same(codec, library, texts):
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = codec.encode(text)
        assert ids == want.ids, ascii(text[:80])
        assert codec.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False), ascii(text[:80])


def test_every_code_point(codec, library):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    _same(codec, library, [" ".join(f"a{c}b!{c}1{c}" for c in points[at : at + 16]) for at in range(0, len(points), 16)])
    odd = [c for c in points if bpe._ODD.match(c)]
    _same(codec, library, [f"x{c}é{c}{c}? Σ{c}'s {c}" for c in odd])


def test_random_strings(codec, library):
    r = random.Random(8)
    marks = [chr(i) for a, b in bpe._NEW_MARKS for i in range(a, b + 1)] + [chr(i) for i in range(0x300, 0x370)]
    some = "abcXYZ019 \n\t'.,!<|>éÉßİıΣςσΆ東京中가각ı‍​ẞﬁ\U0001f309" + "̴̣́ͅ"
    texts = ["".join(r.choice(some) if r.random() < 0.7 else r.choice(marks) for _ in range(r.randint(0, 30))) for _ in range(20_000)]
    texts += ["".join(chr(r.choice((r.randrange(32, 0x3000), r.randrange(0xE000, 0x20000)))) for _ in range(r.randint(1, 20))) for _ in range(20_000)]
    texts += ["", " ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|", "thin " * 50, "x" * 5000, "中" * 300, "𑤸 𑤸", "don't we'll I'D"]
    _same(codec, library, texts)


def test_unknown_ids_are_left_out(codec):
    ids = codec.encode("thin ice")
    assert codec.decode([*ids, 10**6, -1]) == codec.decode(ids) and codec.decode([]) == b""


def test_many_words_equal_one_by_one(codec):
    r = random.Random(5)
    words = ["".join(r.choice("aabcdeinthé中!0") for _ in range(r.randint(0, 60))).encode() for _ in range(6_000)]
    words += [b"", b"a", b"aaaaaaa" * 5, b"a" * 40, b"a" * 41, b"x" * 3_000, bytes(range(128, 168)), "thin".encode(), "zzxqy".encode()] + [t.encode() for t in codec.special]
    merges, lexicon = codec.pieces.merges, codec.pieces.lexicon
    assert merges.encode_many(words) == [merges.encode(w) for w in words] and merges.encode_many([]) == []
    assert lexicon.find_many(words) == [lexicon.find(w) for w in words] and lexicon.find_many([]) == []
    tiny = bpe.Merges([1 << bpe._ID | 1, 2 << bpe._ID | 1, 1 << bpe._ID | 2], [2, 3, 2], [1] * 512)  # later merges make pairs of lower rank
    runs = [b"a" * k for k in range(12)]
    assert tiny.encode_many(runs) == [tiny.encode(w) for w in runs]


def test_many_texts_equal_one_by_one(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "_KEPT", 50)
    monkeypatch.setattr(bpe, "_BLOCK", 40)
    r = random.Random(6)
    some = ["thin", "the", "naïveté", "<|endoftext|>", "࢈", "!?", "中", *("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(300))]
    texts = [" ".join(r.choice(some) for _ in range(r.choice((0, 5, 30, 200)))) for _ in range(300)]
    ids = list(codec.encode_many(texts))
    assert ids == [codec.encode(t) for t in texts] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_frequent_words_are_looked_up_once(monkeypatch):
    monkeypatch.setattr(bpe, "_KEPT", 100)
    own = bpe.Codec(bpe.compiled(bpe.Vocabulary(bpe.default_vocabulary()), ["frequentt"]))
    looked, lexicon = [], own.pieces.lexicon
    find, find_many = lexicon.find, getattr(lexicon, "find_many", None)
    monkeypatch.setattr(lexicon, "find", lambda word: looked.append(word) or find(word))
    monkeypatch.setattr(lexicon, "find_many", lambda words: looked.extend(words) or find_many(words), raising=False)
    r = random.Random(7)
    for _ in range(60):  # more rare words than are kept
        own.encode("frequentt " + " ".join("".join(r.choice("qxzjvk") for _ in range(12)) for _ in range(50)))
    assert looked.count(b"frequentt") == 1 and len(own.pieces) <= 1 + 100 + 50 and len(looked) > 2_000
