"""The part of SimHash near-dedup that holds links to a similarity of shingle sets, and finds those that bits miss.

Fingerprints within three bits are linked as in ``simhash.py``, and each such link is verified on the texts' whole
sets of shingles. But texts of similarity 0.8 differ by up to 17 of 64 bits, which no anchor radius covers, so an
exact join with prefix, length and positional filters then adds the links between what is left apart: in any one order
of all shingles, two sets that are similar enough share one among the first few of each, so only those few are grouped
by shingle. The order is by hash, with shingles that many texts of a sample have put last, so that common passages
rarely bring texts together. Every candidate is verified, so no similar pair is missed and none is invented (but for
collisions of 64-bit hashes).

Two sets differ in at least as many shingles as the parities of their shingles' bits do, so pairs whose parities
differ in more than the similarity allows are left out within the join and never become rows.

Groups of over ``pairs`` sets are first compared with a few of their members, in number of the root of the group's
size; what is linked by that is one component and is not compared again among itself. So a large group of near copies
gives links in proportion to its size, not all its pairs; the last join covers every pair that is still apart.

Up to ``few`` links, of two numbers each, are joined to components on the driver; more, as in ``simhash.py``, in rounds
of tables. Each table costs a file for every task, and executors start a process for each file they write.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import binary_texts, materialize, release, slices, tidied
from .simhash import _mark, connected_components, fingerprint_of, first_rows, links, shingle_hashes

HOT, SHARE, MOST_HOT, PAIRS, HELD = 2, 8, 200_000, 20, 2_000_000
#: So many links are joined to components on the driver (8 MB).
LINKS = 500_000
#: Sampled turns at most; sets of a sample in root of the group's size; links of a sample in known sets that are few.
TURNS, LEADS, FEW, CHANCE = 8, 2, 64, 1 << 20
#: The columns of a set's parities, 64 each.
PARITY = [f"p{i}" for i in range(8)]


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """The sorted hashes of the different shingles of a UTF-8 text."""
    return np.unique(shingle_hashes(text, width))


def _set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _parities(shingles: np.ndarray) -> np.ndarray:
    """For each of the values that part of a hash can take, whether an odd number of the shingles has it."""
    size = 64 * len(PARITY)
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _identify(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                ids, prints, parities = [], [], []
                for text in binary_texts(batch):
                    hashes = shingle_hashes(text, width)
                    ids.append(_set_id(every := np.unique(hashes)))
                    parities.append(_parities(every))
                    prints.append(fingerprint_of(hashes))
                both = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (ids, prints))
                odd = map(pa.array, np.stack(parities, axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *both, *odd], ["doc_id", "mark", "set_id", "fp", *PARITY])

    return run


def _prefixes(width: int, num: int, den: int, late: np.ndarray):
    """The first shingles of each text's set, those in ``late`` (sorted) behind all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                out = [[], [], [], []]
                for text in binary_texts(batch):
                    every = shingle_set(text, width)
                    n = len(every)
                    if not n:
                        continue
                    some = every
                    if len(late):
                        last = late[np.minimum(np.searchsorted(late, every), len(late) - 1)] == every
                        some = np.concatenate((every[~last], every[last]))
                    some = some[: n - -(-num * n // den) + 1]
                    k = len(some)
                    rows = (some.view(np.int64), np.full(k, np.uint64(_set_id(every))).view(np.int64), np.full(k, n, np.int32), np.arange(k, dtype=np.int32))
                    for column, values in zip(out, rows, strict=True):
                        column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["shingle", "set_id", "n", "at"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=4 << 20):
                sets = [shingle_set(t, width).view(np.int64) for t in binary_texts(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(sets, pa.list_(pa.int64()))], ["set_id", "shingles"])

    return run


def _meets(one: str, two: str, num: int, den: int) -> Column:
    """Whether two sets that first meet at this shingle can be similar: by sizes, by what is left behind it and by parities."""
    n, m = F.col(f"{one}.n").cast("long"), F.col(f"{two}.n").cast("long")
    left = F.least(n - F.col(f"{one}.at"), m - F.col(f"{two}.at"))
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{one}.{p}").bitwiseXOR(F.col(f"{two}.{p}"))) for p in PARITY])
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (left * (num + den) >= (n + m) * num) & (differ * (num + den) <= (n + m) * (den - num))


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links u, v, sorted, and of each the smallest node reachable."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    one, two = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low, down = np.minimum(label[one], label[two]), label.copy()
        np.minimum.at(down, label[one], low)
        np.minimum.at(down, label[two], low)
        while not (down == (next_ := down[down])).all():
            down = next_
        if (down == label).all():
            return nodes, nodes[label]
        label = down


def components(linked: DataFrame, few: int = LINKS) -> DataFrame:
    """(node, root) of every node of ``linked`` (u, v), which is written; root is the smallest node reachable."""
    if linked.count() > few:
        return connected_components(linked)
    pairs = linked.toArrow()
    nodes, roots = joined(*(pairs.column(c).to_numpy() for c in ("u", "v")))
    found = pa.table([nodes, roots], schema=pa.schema([("node", pa.int64()), ("root", pa.int64())]))
    return materialize(linked.sparkSession.createDataFrame(found, "node long, root long").coalesce(1), "roots")


def similar_links(docs: DataFrame, prints: DataFrame, width: int, num: int, den: int, few: int = LINKS, hot: int = HOT, share: int = SHARE, pairs: int = PAIRS) -> DataFrame:
    """(u, v): links between different sets of similarity num / den or more, enough to join all that are similar.

    ``prints`` (doc_id, mark, set_id, fp and parities) is of ``docs`` (mark, text).
    """
    schema = "shingle long, set_id long, n int, at int"
    texts = docs.select("mark", "text")
    sample = texts.where(F.pmod("mark", F.lit(share)) == 0)  # sets the order only, which may be any
    counts = sample.mapInArrow(tidied(_prefixes(width, num, den, np.zeros(0, np.uint64))), schema).groupBy("shingle").count()
    often = counts.where(F.col("count") > hot).orderBy(F.desc("count")).limit(MOST_HOT).select("shingle").toPandas()
    late = np.sort(often["shingle"].to_numpy(np.int64).view(np.uint64))
    rows = texts.mapInArrow(tidied(_prefixes(width, num, den, late)), schema).repartition("shingle").dropDuplicates(["shingle", "set_id"])
    known = materialize(prints.groupBy("set_id").agg(F.min("mark").alias("mark"), *[F.first(p).alias(p) for p in PARITY]), "sets")
    rows = rows.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where("k > 1").drop("k")
    rows = materialize(rows.join(known.drop("mark"), "set_id"), "prefixes")
    sets_known = known.count()
    marks = known.select("set_id", "mark")

    def verified(found: DataFrame) -> DataFrame:
        found = materialize(found, "candidates")
        one = found.select(F.explode(F.array("u", "v")).alias("set_id")).distinct().join(marks, "set_id")
        one = F.broadcast(one) if 2 * found.count() <= HELD else one
        sets = materialize(texts.join(one, "mark").dropDuplicates(["mark"]).mapInArrow(tidied(_sets(width)), "set_id long, shingles array<long>"), "shingle-sets")
        a, b = sets.select(F.col("set_id").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("set_id").alias("v"), F.col("shingles").alias("b"))
        # whole sets are compared row by row in the JVM, so that no batch of them has to fit a worker
        shared = F.size(F.array_intersect("a", "b")).cast("long") * (num + den)
        good = materialize(found.join(a, "u").join(b, "v").where(shared >= (F.size("a") + F.size("b")).cast("long") * num).select("u", "v"), "similar")
        for done in (found, sets):
            release(done)
        return good

    def pairs_of(joined: DataFrame) -> DataFrame:
        near = joined.where((F.col("x.root") != F.col("y.root")) & _meets("x", "y", num, den))
        return near.select(F.least("x.set_id", "y.set_id").alias("u"), F.greatest("x.set_id", "y.set_id").alias("v")).distinct()

    def rooted_by(found: DataFrame) -> DataFrame:
        roots = components(found, few)
        return materialize(rows.join(roots, rows.set_id == roots.node, "left").select(*rows.columns, F.coalesce("root", "set_id").alias("root")), "rooted")

    # what the fingerprints bring together: sets of one fingerprint with its least set, and these along links of bits
    sets = prints.select("fp", "set_id").distinct()
    first = sets.groupBy("fp").agg(F.min("set_id").alias("first"))
    bits = links(first.select("fp")).join(first.select(F.col("fp").alias("u"), F.col("first").alias("a")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("b")), "v")
    same = sets.join(first, "fp").select(F.col("first").alias("a"), F.col("set_id").alias("b"))
    close = bits.select("a", "b").unionByName(same).where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    linked = verified(close)
    rooted = rooted_by(linked)
    for turn in range(TURNS):
        # in large groups that several components meet in, some sets, about the root of their number, are compared with all
        wide = rooted.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("low"), F.max("root").alias("high"))
        wide = materialize(wide.where((F.col("low") < F.col("high")) & (F.col("k") > pairs)).select("shingle", "k"), "wide-groups")
        chance = F.pmod(F.xxhash64("set_id", F.lit(turn)), F.lit(CHANCE)) < F.lit(CHANCE * LEADS) / F.sqrt("k")
        leads = rooted.join(wide, "shingle").where(chance).drop("k")
        new = verified(pairs_of(rooted.alias("x").join(leads.alias("y"), F.col("x.shingle") == F.col("y.shingle"))))
        linked, count = linked.unionByName(new), new.count()
        release(wide)
        release(rooted)
        rooted = rooted_by(linked)
        # few links of a sample: what still meets shares passages but is not alike, or little is left
        if count * FEW <= sets_known:
            break
    # shingles whose sets are all in one component have nothing left to say
    size = materialize(rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle"), "shingle-groups")
    open_ = rooted.join(size, "shingle", "left_semi")
    on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.set_id") < F.col("y.set_id"))
    rest = verified(pairs_of(open_.alias("x").join(open_.alias("y"), on)))
    for done in (rows, rooted, size, known):
        release(done)
    return linked.unionByName(rest)


def deduplicate_similar(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, few: int = LINKS, **limits: int) -> DataFrame:
    """One row of each component of near copies, all columns: that with the smallest doc_id.

    Rows are linked if the shingles of ``width`` words of their lowered texts have Jaccard similarity num / den or
    more. Null and empty texts are alike. Null and repeated doc_ids count as in ``simhash.deduplicate``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark(F.col("text")).alias("mark"), F.col("text").cast("string").alias("text"))
    prints = materialize(texts.mapInArrow(tidied(_identify(width)), "doc_id long, mark long, set_id long, fp long, " + ", ".join(f"{p} long" for p in PARITY)), "set-ids")
    roots = components(similar_links(texts, prints, width, num, den, few, **limits), few)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")
    reps = prints.groupBy("set_id").agg(F.min(order).alias("first"))
    return first_rows(docs, reps.join(roots, reps.set_id == roots.node, "left").select("first", F.coalesce("root", "set_id").alias("root")))
