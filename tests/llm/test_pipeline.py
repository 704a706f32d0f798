"""The pipeline against a plain version of every stage, and held-out accuracy of its classifier."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import test_jaccard
from pyspark.sql import functions as F

from palisade.llm import bpe, pii, quality

WHERE = "/root/testdata/sf0.001"


def _held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def _good(docs: list[dict], labels: dict[int, int]) -> list[dict]:
    x = {d["doc_id"]: np.array(quality.statistics((d["text"] or "").encode())) for d in docs}
    own = [np.array([v for i, v in x.items() if labels.get(i) == k and not _held_out(i)]) for k in (0, 1)]
    n, covs = [len(o) for o in own], [np.cov(o.T, bias=True) for o in own]
    within = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    ridge = 0.05 * np.diag(np.diag(within) + 1e-6)

    def density(v: np.ndarray, k: int) -> float:
        cov, d = 0.9 * covs[k] + 0.1 * within + ridge, v - own[k].mean(axis=0)
        return math.log((n[k] + 1) / (sum(n) + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.solve(cov, d)

    def score(v: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-60, min(60, (density(v, 1) - density(v, 0)) / 2))))

    return [d for d in docs if score(x[d["doc_id"]]) >= 0.3]


def _first_of_each(docs: list[dict]) -> list[dict]:
    """The contract's rule: similarity of 0.8 or more in shingles of five words."""
    kept = set(test_jaccard._first_of_each([(d["doc_id"], d["text"]) for d in docs]))
    return sorted((d for d in docs if d["doc_id"] in kept), key=lambda d: d["doc_id"])


def _mixed(docs: list[dict]) -> list[dict]:
    size = lambda d: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or ""))
    groups = collections.defaultdict(list)
    for d in docs:
        groups[d["source"]].append(d)
    names = sorted(groups, key=lambda s: (s is None, s or ""))
    held = {s: sum(map(size, groups[s])) for s in names}
    weight, target, left = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, sum(held.values())
    while len(target) < len(names):
        level = left / sum(weight[s] for s in names if s not in target)
        over = [s for s in names if s not in target and level * weight[s] > 3 * held[s]]
        for s in over or [s for s in names if s not in target]:
            target[s] = 3 * held[s] if over else level * weight[s]
            left -= target[s]
    draw = lambda x: hashlib.md5(f"7:{x}".encode()).hexdigest()
    out = []
    for s in names:
        rate, offset = target[s] / held[s] if held[s] else 0.0, int(draw(s or "")[:5], 16) / 2**20
        for k, d in enumerate(sorted(groups[s], key=lambda d: (math.floor(math.log2(size(d) + 1) * 8), size(d), draw(d["doc_id"]), d["doc_id"]))):
            out += [d] * (math.floor((k + 1) * rate + offset) - math.floor(k * rate + offset))
    return out


def test_pipeline_equals_plain_stages(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import corpus_pipeline

    docs = pd.read_parquet(f"{WHERE}/documents.parquet").astype(object).to_dict("records")
    labels = {r.doc_id: r.quality for r in pd.read_parquet(f"{WHERE}/labels.parquet").itertuples()}
    good = _good(docs, labels)
    once = _first_of_each(good)
    assert len(docs) > len(good) > len(once) > 0
    clean = [d | {"text": None if d["text"] is None else pii.masked(d["text"], pii.trained())} for d in once]
    library, want = tokenizers.Tokenizer.from_file(bpe.default_vocabulary()), collections.Counter()
    library.no_truncation()
    library.no_padding()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d in _mixed(clean):
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        want[d["doc_id"], len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))] += 1
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, WHERE).collect())
    assert got == want


def test_stages_keep_the_columns_of_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{WHERE}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, WHERE).columns == docs.columns, name


def test_stages_take_nulls_repeats_long_texts_and_empty_tables(spark):
    import corpus_pipeline

    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "word " * 50_000, "en", "a"), (3, "word " * 50_000, "en", "a"), (3, "a text that differs", "fr", "b"), (None, None, None, None), (None, "a@b.co has no id", "en", "a")]
    kind = spark.read.parquet(f"{WHERE}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], kind).withColumn("copies", F.lit(1)).withColumn("score", F.lit("x"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, table, WHERE)
            assert left.count() <= 3 * table.count(), name
            assert name == "bpe" or left.columns == docs.columns, name
    assert corpus_pipeline.near_dedup(spark, docs, WHERE).count() == 4


def test_classifier_on_held_out_rows(spark):
    where = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    labels = pd.read_parquet(f"{where}/labels.parquet").set_index("doc_id").quality
    found = [r for r in quality.classify(docs, spark.read.parquet(f"{where}/labels.parquet")).collect() if r.held_out and r.doc_id in labels.index]
    assert all(r.held_out == _held_out(r.doc_id) for r in found)
    assert np.mean([r.predicted == labels[r.doc_id] for r in found]) > 0.95
