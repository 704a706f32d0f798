"""Substring deduplication by a log-structured fingerprint index.

Every text is cut into windows of ``WINDOW`` words. Neighbouring windows whose smallest gram hash is the same form a
run; equal windows always have the same smallest gram, wherever they stand, so a run is filed under it together with a
digest of 128 bits of the words of its whole span. The runs of a batch, each with its first document, become an immutable
table in buckets by gram, sorted. A new batch's table is merge-joined with the older ones, bucket by bucket, without a
shuffle, and judged; then tables of one level are compacted into one of the next.

A run that agrees with an earlier one in gram is a candidate. It is verified by the digest of its words: runs that agree
in that are the same words. Where one gram has runs with different words, which is so at the edges of shared passages,
the texts of one document per run are read again and digests of the words of their windows compared one by one, so that
no shared window is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ORDERED, SortedTable, binary_texts, configured, documents, materialize, release, slices

WINDOW, GRAM, LONGEST = 50, 12, 64
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
RUN = "gram long, d1 long, d2 long, n int, doc_id long, place long"
KEY = ["gram", "d1", "d2", "n"]
#: A place is 32 bits of the hash of its text, which tell texts apart that share a doc_id, and the number of the first word.
_START = 31


def _powers(base: int, n: int, known: dict = {}) -> np.ndarray:  # noqa: B006  kept from call to call
    have = known.get(base)
    if have is None or len(have) < n:
        size = max(n, 4096)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base, np.uint64))), dtype=np.uint64)
        known[base] = have
    return have[:n]


class _Hashes(dict):
    """Word to hash; forgets all once it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()


def _lowest(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` neighbours, by doubling."""
    span = 1
    while span * 2 <= n:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (n - span)], values[n - span :])


def runs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, start, n) of the runs of windows of a text."""
    count = len(words)
    if count < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashed = np.fromiter(map(_words.__getitem__, words), np.uint64, count)
    sums = np.zeros(count + 1, np.uint64)
    np.cumsum(hashed * _powers(_INVERSE, count), out=sums[1:])
    grams = (sums[GRAM:] - sums[:-GRAM]) * _powers(_ODD, count - GRAM + 1)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    least = _lowest(grams, WINDOW - GRAM + 1)
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    sizes = np.diff(np.concatenate((starts, [len(least)])))
    if sizes.max() > LONGEST:  # periodic texts: cut, as any cut gives right results
        starts = np.concatenate([np.arange(s, s + k, LONGEST) for s, k in zip(starts.tolist(), sizes.tolist(), strict=True)])
        sizes = np.diff(np.concatenate((starts, [len(least)])))
    return least[starts], starts, sizes


def _layout(words: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by spaces, with the words' starts and ends."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return b" ".join(words), np.concatenate(([0], ends[:-1] + 1)), ends


def _digests(line: bytes, spans) -> np.ndarray:
    """128 bits of each span's words, as two signed numbers."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(line[s:e]) for s, e in spans), "<i8").reshape(-1, 2)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            out = [[], [], [], [], [], []]
            ids, marks = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist()
            for doc, mark, text in zip(ids, marks, binary_texts(batch), strict=True):
                words = text.split()
                gram, start, n = runs(words)
                if not len(gram):
                    continue
                line, begin, end = _layout(words)
                digest = _digests(line, zip(begin[start].tolist(), end[start + n + WINDOW - 2].tolist(), strict=True))
                for column, values in zip(out, (gram.view(np.int64), digest[:, 0], digest[:, 1], n.astype(np.int32), np.full(len(n), doc), start + (mark << _START)), strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], [*KEY, "doc_id", "place"])


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    mark = F.coalesce(F.xxhash64(text), F.lit(0).cast("long")).bitwiseAND(F.lit((1 << 32) - 1).cast("long"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), text.alias("text"))


def window_runs(docs: DataFrame) -> DataFrame:
    """The runs of all rows with a doc_id."""
    return _texts(docs).where("doc_id is not null").mapInArrow(_cut, RUN)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each window of the runs listed beside a text."""
    for whole in batches:
        for batch in slices(whole, limit=4 << 20):
            out = [[], [], [], [], [], [], [], []]
            ids = batch.column("doc_id").to_pylist()
            for doc, text, todo in zip(ids, binary_texts(batch), batch.column("todo").to_pylist(), strict=True):
                line, begin, end = _layout(text.split())
                for run in todo:
                    n, at = run["n"], run["place"] & ((1 << _START) - 1)
                    found = _digests(line, zip(begin[at : at + n].tolist(), end[at + WINDOW - 1 : at + n + WINDOW - 1].tolist(), strict=True))
                    for column, values in zip(out, (*(np.full(n, run[k]) for k in KEY), np.full(n, doc), np.arange(n), found[:, 0], found[:, 1]), strict=True):
                        column.append(values)
            if out[0]:
                kinds = (np.int64, np.int64, np.int64, np.int32, np.int64, np.int32, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(out, kinds, strict=True)], [*KEY, "doc_id", "i", "w1", "w2"])


class FingerprintIndex:
    """Levels of immutable sorted tables of runs (``KEY``) with the first document that has them (doc_id, place).

    Batches must come in the order of doc_id: what is indexed is earlier than what comes.
    """

    def __init__(self, buckets: int, fanout: int = 2):
        self.buckets, self.fanout, self.levels, self.compactions = buckets, fanout, [[]], 0

    def _save(self, runs: DataFrame) -> SortedTable:
        return SortedTable(runs, "palisade_runs", "gram", KEY, self.buckets)

    def add(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """Files the runs of a batch and judges them: (doc_id, mark, start, n), windows whose words start in an earlier document.

        ``texts`` (doc_id, mark, text) must have the documents that are indexed and those of the batch.
        """
        new = self._save(batch.groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.min_by("place", "doc_id").alias("place"), F.max("doc_id").alias("high")))
        covered = self._judge(batch, new.df, texts)
        self.levels[0].append(new)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1
        return covered

    def _compact(self, level: int) -> None:
        """Merges the tables of a level into one of the next: the first document of each run."""
        old = self.levels[level]
        with configured(old[0].df.sparkSession, ORDERED):
            every = old[0].df
            for table in old[1:]:
                every = every.unionByName(table.df)
            merged = self._save(every.groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.min_by("place", "doc_id").alias("place"), F.max("high").alias("high")))
        for table in old:
            table.release()
        self.levels[level] = []
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level + 1].append(merged)
        self.compactions += 1

    def earlier(self, new: DataFrame) -> DataFrame | None:
        """The indexed runs that share a gram with the new table, by merge joins of sorted buckets."""
        found = [t.df.hint("merge").join(new.select("gram"), "gram", "left_semi").select(*KEY, "doc_id", "place") for level in self.levels for t in level]
        for df in found[1:]:
            found[0] = found[0].unionByName(df)
        return found[0] if found else None

    def _judge(self, batch: DataFrame, new: DataFrame, texts: DataFrame) -> DataFrame:
        with configured(new.sparkSession, ORDERED):
            old = self.earlier(new)
            # of the new runs those matter whose gram has runs of other words too, here or earlier, or several documents
            grams = new.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("doc_id").alias("low"), F.max("high").alias("high")).where("kinds > 1 and low < high").select("gram")
            near = new.select(*KEY, "doc_id", "place")
            twice = new.where("high > doc_id").select(*KEY, "doc_id", "place")
            near = near.join(grams, "gram", "left_semi")
            if old is not None:
                old = materialize(old, "index-earlier")
                near = near.unionByName(old).unionByName(new.select(*KEY, "doc_id", "place").join(old.select("gram").distinct(), "gram", "left_semi"))
            near = near.unionByName(twice).groupBy(*KEY).agg(F.min("doc_id").alias("doc_id"), F.min_by("place", "doc_id").alias("place"))
            near = materialize(near, "index-near")
        if old is not None:
            release(old)
        grams = near.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("kinds > 1 and low < high").select("gram")
        grams = materialize(grams, "index-grams")  # a table of its own, so that the join can split a hot gram
        # one gram, several runs, from more than one document: compare windows
        mixed = near.join(grams, "gram", "left_semi").withColumn("mark", F.shiftright("place", _START))
        todo = mixed.groupBy("doc_id", "mark").agg(F.collect_list(F.struct(*KEY, "place")).alias("todo"))
        one = texts.join(todo, ["doc_id", "mark"]).select("doc_id", "text", "todo")
        found = materialize(one.mapInArrow(_windows, "gram long, d1 long, d2 long, n int, doc_id long, i int, w1 long, w2 long"), "index-windows")
        same = ["gram", "w1", "w2"]
        first = found.groupBy(*same).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
        lows = found.join(first, same).groupBy(*KEY).agg(F.collect_list(F.struct("i", "low")).alias("lows"))  # at most LONGEST
        known = near.select(*KEY, F.col("doc_id").alias("own")).join(lows, KEY, "left")
        # an earlier run of the same words covers all windows of a run, else those count that are found earlier
        start = F.col("place").bitwiseAND(F.lit((1 << _START) - 1).cast("long")).cast("int")
        parts = F.transform(F.filter(F.coalesce("lows", F.array()), lambda x: x["low"] < F.col("doc_id")), lambda x: F.struct((start + x["i"]).alias("start"), F.lit(1).alias("n")))
        spans = F.when(F.col("doc_id") > F.col("own"), F.array(F.struct(start.alias("start"), F.col("n").alias("n")))).otherwise(parts)
        hits = batch.join(known, KEY).select("doc_id", F.shiftright("place", _START).alias("mark"), F.explode(spans).alias("s")).select("doc_id", "mark", "s.*")
        hits = materialize(hits, "index-covered")
        for done in (near, grams, found):
            release(done)
        return hits


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            total, removed, kept = [], [], []
            for text, spans in zip(binary_texts(batch), batch.column("spans").to_pylist(), strict=True):
                words = text.split()
                total.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    start = np.array([s["start"] for s in spans])
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + np.array([s["n"] for s in spans]) + WINDOW - 1, -1)
                    stays = (np.cumsum(edge[:-1]) == 0).tolist()
                    words = [w for w, k in zip(words, stays, strict=True) if k]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _strip(batches):
        digests = pa.array([hashlib.sha256(x).hexdigest() for x in batch.column("kept").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], digests], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _with_spans(docs: DataFrame, batches: int, fanout: int = 2) -> tuple[DataFrame, FingerprintIndex]:
    texts, cut = _texts(docs), []
    if batches > 1:
        cut = docs.select(F.col("doc_id").cast("double").alias("d")).where("d is not null").approxQuantile("d", [k / batches for k in range(1, batches)], 0.01)
    number = sum(((F.col("doc_id") > c).cast("int") for c in cut), F.lit(0))
    rows = materialize(window_runs(docs).withColumn("batch", number), "window-runs", ["batch"])
    index = FingerprintIndex(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), fanout)
    covered = None
    for k in range(batches):  # in the order of doc_id, as they would arrive
        there = texts.where(F.col("doc_id") <= cut[k]) if k < len(cut) else texts
        found = index.add(rows.where(F.col("batch") == k).drop("batch"), there)
        covered = found if covered is None else covered.unionByName(found)
    release(rows)
    spans = covered.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    for level in index.levels:
        for table in level:
            table.release()
    return texts.join(spans, ["doc_id", "mark"], "left").select("doc_id", "text", "spans"), index


def deduplicate_substrings(docs: DataFrame, batches: int = 3) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``docs`` (doc_id, text); kept: the words left, as UTF-8 bytes.

    A word goes if a window of 50 words over it also starts in a row with a smaller doc_id. Null and empty texts have
    no words; a null doc_id neither covers nor is covered; rows that repeat a doc_id don't cover each other. Other
    columns are ignored.
    """
    return _with_spans(docs, batches)[0].mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept binary")


def op10_substring(spark, sf_dir):
    found, _ = _with_spans(documents(spark, sf_dir), 3)
    return found.mapInArrow(_digested, "doc_id long, n_words long, n_removed long, kept_sha256 string")
