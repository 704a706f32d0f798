"""The fingerprint index: merge joins without shuffles, compaction, and batches judged as they come."""

import random

from pyspark.sql import functions as F

from palisade.llm import common, substring


def _docs(spark):
    r = random.Random(9)
    words = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    passages = [words(70) for _ in range(4)]
    return spark.createDataFrame([(i, f"{words(r.randint(0, 60))} {r.choice(passages)} {words(r.randint(0, 60))}") for i in range(60)], "doc_id long, text string")


def _found(index, docs, batches):
    rows, texts, out = common.materialize(substring.window_runs(docs), "test-runs"), substring._texts(docs), []
    for k in range(batches):
        mine = F.floor(F.col("doc_id") * batches / 60) == k
        hits = index.add(rows.where(mine), texts.where(F.floor(F.col("doc_id") * batches / 60) <= k))
        out.append({(h.doc_id, h.start + d) for h in hits.collect() for d in range(h.n)})
    return out


def test_batches_are_judged_as_they_come_and_tables_compacted(spark):
    docs = _docs(spark)
    first, want = {}, set()
    for i, text in sorted(map(tuple, docs.collect())):
        w = text.split()
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                want.add((i, k))
    assert want
    for batches, compactions in ((1, 0), (2, 1), (4, 3), (5, 3)):
        index = substring.FingerprintIndex(4)
        found = _found(index, docs, batches)
        assert index.compactions == compactions
        for k, hits in enumerate(found):
            assert hits == {(i, at) for i, at in want if i * batches // 60 == k}


def test_merge_joins_neither_shuffle_nor_sort(spark):
    docs, index = _docs(spark), substring.FingerprintIndex(4, fanout=9)
    _found(index, docs, 2)
    old, new = (t.df for t in index.levels[0])
    with common.configured(spark, common.ORDERED):
        one = substring.FingerprintIndex(4)
        one.levels[0] = index.levels[0][:1]
        joined = one.earlier(new)._jdf.queryExecution().executedPlan().toString()
        merged = old.unionByName(new).groupBy(*substring.KEY).agg(F.min("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joined and "Exchange" not in joined + merged and "Sort [" not in joined
