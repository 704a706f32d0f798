"""Near copies by shingles against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest

WHERE = "/root/testdata/sf0.001"


def _shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def _first_of_each(docs):
    docs = sorted(docs)
    sets, label = [_shingles(t) for _, t in docs], np.arange(len(docs))
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    while not (label == (new := np.where(near, label[None, :], len(docs)).min(axis=1))).all():
        label = new
    return [docs[k][0] for k in np.flatnonzero(label == np.arange(len(docs)))]


def _edited(r, words, k):
    """``k`` words changed, each in five shingles of its own."""
    words = list(words)
    for at in r.sample(range(5, len(words) - 5, 10), k):
        words[at] = f"new{r.random()}"
    return " ".join(words)


@pytest.mark.parametrize("limits", [{}, {"hot": 2, "share": 1, "pairs": 0}])
def test_stage_links_similar_texts_far_apart_in_bits(spark, limits):
    from palisade.llm.jaccard import deduplicate_similar

    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    texts = []
    for _ in range(6):
        one = words(88)
        texts += [" ".join(one), *(_edited(r, one, k) for k in (1, 1, 2, 3, 4))]
    passage = words(40)
    texts += [" ".join(words(12) + passage) for _ in range(8)] + [" ".join(words(4) + passage) for _ in range(8)] + ["", "a b", "A  b", "a b c d e f", "a b c d e g"]
    docs = list(enumerate(texts))
    r.shuffle(docs)
    got = deduplicate_similar(spark.createDataFrame(docs, "doc_id long, text string"), **limits)
    assert sorted(x.doc_id for x in got.collect()) == _first_of_each(docs)


def test_stage_equals_brute_force(spark):
    import corpus_pipeline

    docs = [(int(i), t) for i, t in pd.read_parquet(f"{WHERE}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)]
    got = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{WHERE}/documents.parquet"), WHERE)
    assert sorted(x.doc_id for x in got.collect()) == _first_of_each(docs)


def test_parities_never_differ_more_than_the_sets():
    import numpy as np

    from palisade.llm.jaccard import _parities

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 60, 3000):
        for other in (0, 1, 20, 400):
            one = rng.integers(0, 1 << 64, n, np.uint64)
            two = np.concatenate((one[: n - n // 8], rng.integers(0, 1 << 64, other, np.uint64)))
            apart = len(np.setxor1d(one, two))
            differ = int(np.bitwise_count((_parities(np.unique(one)) ^ _parities(np.unique(two))).view(np.uint64)).sum())
            assert differ <= apart and differ % 2 == apart % 2


def test_components_on_the_driver_equal_those_of_tables(spark):
    from palisade.llm.jaccard import components, joined

    r = random.Random(5)
    pairs = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)]
    r.shuffle(pairs)
    nodes, roots = joined(*np.array(pairs, np.int64).T)
    linked = spark.createDataFrame(pairs, "u long, v long")
    low = {n: n for p in pairs for n in p}
    for _ in low:
        for u, v in pairs:
            low[u] = low[v] = min(low[u], low[v])
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == low
    here, there = ({x.node: x.root for x in components(linked, few).collect()} for few in (len(pairs), len(pairs) - 1))
    assert here == low and all(low[n] == n for n in low.keys() - there.keys()) and there.items() <= low.items()
    assert components(linked.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"few": 0}])
def test_few_links_need_no_rounds_of_tables(spark, monkeypatch, limits):
    from palisade.llm import jaccard, simhash

    written = []
    for module in (jaccard, simhash):
        monkeypatch.setattr(module, "materialize", lambda df, name, f=module.materialize: written.append(name) or f(df, name))
    docs = [(int(i), t) for i, t in pd.read_parquet(f"{WHERE}/documents.parquet")[["doc_id", "text"]].itertuples(index=False)]
    got = jaccard.deduplicate_similar(spark.read.parquet(f"{WHERE}/documents.parquet"), **limits)
    assert sorted(x.doc_id for x in got.collect()) == _first_of_each(docs)
    assert ("edges" in written) == bool(limits) and "candidate-marks" not in written
