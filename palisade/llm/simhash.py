"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into two 32-bit halves. Two fingerprints that differ in at most three bits differ in at
most one bit in one of the halves, so each half is searched with threshold 1. The anchors of a half are the words of
a covering code with radius 1: the perfect Hamming (31, 26) code with the remaining bit kept as it is. Every
fingerprint has one home anchor (its nearest code word) and visits every anchor within radius + threshold = 2; by the
triangle inequality a pair within threshold meets at the home of either. Only homes are compared with visitors, on
all 64 bits, and each group hands on a spanning forest of its links, never all pairs.

Anchors with more than ``block`` homes are dealt out: homes go to one of several blocks, visitors to all of them.
That is exact at any size and bounds what one task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, materialize, release, slices

SEED = 42
_LANE = (np.arange(8, dtype=np.uint16) * 256)[None, :]
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
_PIECE = 1 << 16


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """The hashes of a UTF-8 text's shingles, repeats included: all words as one if there are ``width`` at most."""
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)] if words else [], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))[: len(words) - width + 1]
    ends = np.concatenate((gaps[width - 1 :], [len(line)]))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; 0 without any."""
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(hashes), _PIECE):
        some = hashes[at : at + _PIECE].astype("<u8")
        counts += np.bincount((some.view(np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of a UTF-8 text; 0 if it has no words."""
    return fingerprint_of(shingle_hashes(text, width))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                prints = np.array([fingerprint(t, width) for t in binary_texts(batch)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(prints)], ["doc_id", "mark", "fp"])

    return run


def _mark(text: Column) -> Column:
    """Tells rows apart that repeat a doc_id with another text; never null."""
    return F.xxhash64(text.cast("string"))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, mark, fp) of every row, mark a hash of the text; null and empty texts get fingerprint 0."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))
    return few.mapInArrow(_fingerprints(width), "doc_id long, mark long, fp long")


_SYNDROME = np.zeros(1 << 16, np.uint8)
for _i in range(16):
    _SYNDROME[1 << _i : 2 << _i] = _SYNDROME[: 1 << _i] ^ _i
_SYNDROME_HIGH = np.zeros(1 << 16, np.uint8)
for _i in range(16):
    _SYNDROME_HIGH[1 << _i : 2 << _i] = _SYNDROME_HIGH[: 1 << _i] ^ (16 + _i)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Homes (n) and visited anchors (n, 17) of 32-bit words; visits that don't exist repeat the home.

    Bits 1 to 31 carry the Hamming code (a bit's syndrome is its index), bit 0 stands for itself.
    """
    half = half.astype(np.uint64)
    s = (_SYNDROME[half & 0xFFFF] ^ _SYNDROME_HIGH[half >> np.uint64(16)]).astype(np.uint64)
    one = np.uint64(1)
    flip = np.where(s > 0, one << s, 0).astype(np.uint64)
    home = half ^ flip
    visits = np.repeat(home[:, None], 17, axis=1)
    visits[:, 1] = home ^ one
    # pairs of bits (i, i ^ s) with syndrome s: for each i below its partner, skipping 0 and s
    i = np.arange(1, 32, dtype=np.uint64)[None, :]
    j = i ^ s[:, None]
    good = (i < j) & (s[:, None] > 0)
    rows, cols = np.nonzero(good)
    nth = (np.cumsum(good, axis=1) - 1)[rows, cols]
    visits[rows, 2 + nth] = half[rows] ^ (one << i[0, cols]) ^ (one << j[rows, cols])
    return home, visits


def _deal(homes_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                fp = whole.column("fp").slice(at, 20_000).to_numpy(zero_copy_only=False)
                bits = fp.view(np.uint64)
                anchor, value, visitor = [], [], []
                for k, half in enumerate((bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32))):
                    home, visits = anchors(half)
                    mark = np.uint64(k << 32)
                    anchor.append((home | mark).view(np.int64))
                    value.append(fp)
                    visitor.append(np.zeros(len(fp), bool))
                    if not homes_only:
                        seen = np.ones(visits.shape, bool)
                        seen[:, 1:] = visits[:, 1:] != home[:, None]
                        anchor.append((visits[seen] | mark).view(np.int64))
                        value.append(np.repeat(fp, seen.sum(axis=1)))
                        visitor.append(np.ones(len(value[-1]), bool))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (anchor, value, visitor)], ["anchor", "fp", "visitor"]
                )

    return run


def _compare(distance: int):
    """Rows sorted by (anchor, salt, visitor): streams groups, holds one group's homes, yields links."""

    class Group:
        def __init__(self):
            self.homes, self.label = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def visit(self, seen: np.ndarray, out: list) -> None:
            for at in range(0, len(seen), step := max(1, (1 << 21) // max(1, len(self.homes)))):
                some = seen[at : at + step]
                near = np.bitwise_count(some[:, None] ^ self.homes[None, :]) <= distance
                some, near = some[k := near.any(axis=1)], near[k]
                if not len(some):
                    continue
                big = len(self.homes)
                while True:  # the smallest label that a visitor sees spreads to all homes it sees
                    low = np.where(near, self.label[None, :], big).min(axis=1)
                    down = np.minimum(np.where(near, low[:, None], big).min(axis=0), self.label)
                    np.minimum.at(down, self.label, down)  # and to the roots that these had
                    down = down[down]
                    if (down == self.label).all():
                        break
                    self.label = down
                keep = self.homes[low] != some
                out.append(np.stack([some[keep], self.homes[low][keep]]))

        def close(self, out: list) -> None:
            keep = self.label != np.arange(len(self.label))
            out.append(np.stack([self.homes[keep], self.homes[self.label[keep]]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, single = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            a, salt, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "salt", "visitor"))
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cut = np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (salt[1:] != salt[:-1])) + 1, [len(a)]))
            guests = np.concatenate(([0], np.cumsum(v)))
            n_guests, out = guests[cut[1:]] - guests[cut[:-1]], []
            n_homes = np.diff(cut) - n_guests
            # groups wholly inside the batch with no home, or a home that only itself visits, have no links
            todo = (n_homes > 0) & (n_guests > 1)
            todo[[0, -1]] = True
            for g in np.flatnonzero(todo).tolist():
                s, e = int(cut[g]), int(cut[g + 1])
                if key != (a[s], salt[s]):
                    if group is not None:
                        group.close(out)
                    key, group = (a[s], salt[s]), Group()
                mid = s + int(n_homes[g])
                if mid > s:
                    group.homes = np.concatenate((group.homes, fp[s:mid]))
                    group.label = np.arange(len(group.homes))
                if len(group.homes):
                    group.visit(fp[mid:e], out)
            if found := [x for x in out if x.shape[1]]:
                u, w = np.concatenate(found, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w)], ["u", "v"])
        if group is not None:
            out = []
            group.close(out)
            u, w = np.concatenate(out, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w)], ["u", "v"])

    return run


def links(distinct: DataFrame, distance: int = 3, block: int = 2048) -> DataFrame:
    """(u, v): a spanning forest, per anchor, of all pairs of different fingerprints within ``distance`` (3 at most)."""
    if not 0 <= distance <= 3:
        raise ValueError("the two halves are searched with threshold 1, which finds distances up to 3")
    schema = "anchor long, fp long, visitor boolean"
    hot = materialize(
        distinct.mapInArrow(_deal(True), schema).groupBy("anchor").count().where(F.col("count") > block)
        .select(F.col("anchor").alias("hot"), F.ceil(F.col("count") / block).cast("int").alias("n")),
        "hot-anchors",
    )
    rows = distinct.mapInArrow(_deal(False), schema)
    if hot.isEmpty():
        rows = rows.withColumn("salt", F.lit(0))
    else:
        rows = rows.join(hot, rows.anchor == hot.hot, "left").withColumn("n", F.coalesce("n", F.lit(1)))
        own = F.array(F.pmod(F.xxhash64("fp"), F.col("n").cast("long")).cast("int"))
        salts = F.when(F.col("visitor"), F.sequence(F.lit(0), F.col("n") - 1)).otherwise(own)
        rows = rows.select("anchor", "fp", "visitor", F.explode(salts).alias("salt"))
    return (
        rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "visitor")
        .mapInArrow(_compare(distance), "u long, v long").distinct()
    )


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v), root the smallest node reachable.

    Alternates large-star and small-star steps as joins; every round is written to the shared folder.
    """
    loose = F.col("u") != F.col("v")
    edges, mark = materialize(edges.where(loose).select("u", "v"), "edges"), None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(loose).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = materialize(small.select("e.u", "e.v").where(loose).distinct(), "edges")
        release(edges)
        edges = new
        total = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if total == mark:
            break
        mark = total
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _components(prints: DataFrame, first: Column, distance: int) -> DataFrame:
    """(fp, first, root) of every fingerprint: its least ``first`` and the fingerprint that stands for its component."""
    reps = prints.groupBy("fp").agg(F.min(first).alias("first"))
    roots = connected_components(links(reps.select("fp"), distance))
    return reps.join(roots, reps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id among all rows whose fingerprints are linked by steps of at most
    ``distance`` bits. Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay; a
    null doc_id never becomes a component_id unless its component has no other. Other columns are ignored.
    """
    prints = materialize(fingerprints(docs, width).select("doc_id", "fp"), "fingerprints")
    reps = _components(prints, F.col("doc_id"), distance)
    lowest = reps.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(reps.join(lowest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def first_rows(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The row of ``docs`` with the least ``first`` of each root, for ``reps`` (first, root); of rows alike any one."""
    kept = reps.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.mark").alias("kept_mark"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), _mark(F.col("text")).alias("mark"))
    kept = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")), "left_semi")
    return kept.dropDuplicates(["id", "mark"]).select("row.*")


def deduplicate(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """One row of each component of near fingerprints, all columns: that with the smallest doc_id.

    A null doc_id comes last, and of rows that repeat a doc_id within a component the smallest text hash counts. Rows
    that repeat a doc_id with a text that is no near copy are components of their own and stay. Of rows alike in
    doc_id and text, any one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    prints = materialize(fingerprints(docs, width), "fingerprints")
    return first_rows(docs, _components(prints, order, distance))


def op2_simhash(spark, sf_dir):
    from .common import documents

    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
