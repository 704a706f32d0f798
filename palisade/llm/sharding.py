"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked; each group of them is a node, and a link is cut where its ends are in different
shards. Every document starts in a shard by hash. In each round nodes move to the shard that holds most of their
documents, as far as the quota of that shard allows, and in the last round wherever that is. Groups too large for one
shard are cut into as few nodes as fit. Rounds join and rewrite only the table of (node, shard, documents), at most a row
per shard for a node however large it is; documents themselves are joined once, by node and first shard, so that a hot
group is dealt over as many keys as there are shards.

At the end the counts are made exact: each shard keeps its linked documents first, large groups before small ones, and
those over the quota fill the shards below it, group by group. At most one group is cut where a shard is full or filled
up. The order within a shard is fixed by hashes of node and doc_id; how it is cut into cells to be sorted is not seen in
the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distributed_rank, documents, materialize, release


def _unit(*columns) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def propagate(linked: DataFrame, quota: int, rounds: int) -> DataFrame:
    """(node, shard, n, all), one row of every node: the shard where it ends. ``linked`` has a row per node and first shard."""
    held = linked
    for turn in range(rounds):
        # ties go to the shard that the node's hash prefers, so that small groups spread evenly
        wish = held.groupBy("node").agg(F.max(F.struct("n", F.xxhash64("node", "shard").alias("h"), "shard"))["shard"].alias("wish"))
        moves = held.join(wish, "node")
        last = turn == rounds - 1
        if not last:
            leaves = F.col("shard") != F.col("wish")
            into = moves.where(leaves).groupBy(F.col("wish").alias("s")).agg(F.sum("n").alias("into"))
            have = moves.groupBy(F.col("shard").alias("s")).agg(F.sum(F.when(~leaves, F.col("n")).otherwise(0)).alias("stay"))
            # one row per shard: how much of the inflow its quota lets in once those that wish to leave are gone
            free = F.greatest(F.lit(0.0), (F.lit(quota) - F.coalesce("stay", F.lit(0))) / F.col("into"))
            room = into.join(have, "s", "left").select(F.col("s").alias("wish"), free.alias("rate"))
            moves = moves.join(F.broadcast(room), "wish", "left")  # as many rows as shards
            goes = _unit("node", F.lit(turn)) < F.coalesce("rate", F.lit(1.0))
        else:
            goes = F.lit(True)
        new = moves.withColumn("shard", F.when(goes, F.col("wish")).otherwise(F.col("shard"))).groupBy("node", "shard").agg(F.sum("n").alias("n"), F.max("all").alias("all"))
        new = materialize(new, "shard-held")
        if turn:
            release(held)
        held = new
    return held


def _ranked(rows: DataFrame, parts: list[str], seed: int, cell_rows: int, lots: int, name: str) -> DataFrame:
    """Ranks by class (large groups first), then by hashes of node and document.

    Cells are ranges of that order: of nodes, or, in classes of groups past ``cell_rows``, of the documents of a node.
    """
    by, doc = F.xxhash64("node", F.lit(seed)), F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed))
    level = F.floor(F.log2("all")).cast("int")
    big = level >= cell_rows.bit_length() - 1
    pieces = 1 + F.floor(F.col("all") / cell_rows)
    part = F.floor((F.shiftright("_doc", 33) + (1 << 30)) * pieces / float(1 << 31))
    cells = rows.withColumn("_by", by).withColumn("_doc", doc).withColumn("_class", -level)
    cells = cells.withColumn("_lot", F.when(big, F.col("_by")).otherwise(F.shiftright("_by", 64 - max(1, lots.bit_length()))))
    cells = cells.withColumn("_node", F.when(big, F.col("node")).otherwise(F.lit(0))).withColumn("_part", F.when(big, part).otherwise(F.lit(0)))
    found = distributed_rank(cells, parts, ["_class", "_lot", "_node", "_part"], [F.col("_by"), F.col("node"), F.col("_doc"), F.col("doc_id")], name)
    return found.drop("_by", "_doc", "_class", "_lot", "_node", "_part")


def balanced_shards(docs: DataFrame, shards: int = 40, rounds: int = 4, cell_rows: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs`` (doc_id, text).

    Row counts of the shards differ by one at most; slots run from 0 within a shard. Null texts have size 16 and
    the check sum of no bytes and are linked to nothing. Equal texts share a shard where quotas allow. Repeated rows
    take a slot each. Other columns are ignored. ``cell_rows``, about how many rows are sorted together, is not seen
    in the result.
    """
    text = F.encode(F.col("text").cast("string"), "UTF-8")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"),
    )
    base = materialize(base, "shard-base")
    n = base.count()
    quota, cell_rows = max(1, n // shards), cell_rows or min(500_000, max(200, n // 2000))
    # only what no shard can hold is cut, into as few pieces as fit; fewer groups than shards are as large as that
    large = base.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > quota)
    piece = F.coalesce(F.floor(_unit("doc_id", "key", F.lit(1)) * F.ceil(F.col("members") / F.lit(quota))), F.lit(0))
    node = F.when(F.col("key").isNull(), F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("key", piece))
    start = F.pmod(F.xxhash64("doc_id", "key"), F.lit(shards)).cast("int")
    rows = base.join(F.broadcast(large), "key", "left").select("doc_id", "size", "text_crc32", F.col("key").isNotNull().alias("texted"), node.alias("node"), start.alias("start"))
    rows = materialize(rows, "shard-rows")
    release(base)
    held = rows.where("texted").groupBy("node", F.col("start").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    whole = held.groupBy("node").agg(F.sum("n").alias("all")).where("all > 1")
    linked = materialize(held.join(whole, "node").select("node", "shard", "n", "all"), "shard-held")
    placed = propagate(linked, quota, rounds)
    # a row per node and first shard, so that the documents of a large node are joined by many keys
    goals = linked.select("node", F.col("shard").alias("start")).join(placed.select("node", "shard", "all"), "node")
    state = rows.join(goals, ["node", "start"], "left").select("doc_id", "size", "text_crc32", "node", F.coalesce("all", F.lit(1)).alias("all"), F.coalesce("shard", "start").alias("shard"))
    state = materialize(state, "shard-state")
    for done in (rows, linked, placed):
        release(done)
    counts = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}  # a row per shard
    goal = [n // shards + (s < n % shards) for s in range(shards)]
    ranked = _ranked(state, ["shard"], 1, cell_rows, n // shards // cell_rows, "_rank")
    ranked = materialize(ranked.withColumn("_stays", F.col("_rank") <= F.get(F.array(*[F.lit(g) for g in goal]), F.col("shard"))), "shard-ranked")
    release(state)
    stay = ranked.where("_stays").select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - 1).cast("long").alias("slot"))
    spare = [max(0, g - counts.get(s, 0)) for s, g in enumerate(goal)]
    ends, total = [], 0
    for s in range(shards):
        total += spare[s]
        ends.append(total)
    over = _ranked(ranked.where("not _stays").drop("shard", "_rank", "_stays"), [], 2, cell_rows, n // cell_rows, "_place")
    to = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col("_place"))).cast("int")
    begins = F.array(*[F.lit(e - c - min(counts.get(s, 0), goal[s])) for s, (e, c) in enumerate(zip(ends, spare, strict=True))])
    moved = over.withColumn("shard", to).select("doc_id", "size", "text_crc32", "shard", (F.col("_place") - 1 - F.get(begins, F.col("shard"))).cast("long").alias("slot"))
    return stay.unionByName(moved)


def op4_sharding(spark, sf_dir):
    found = balanced_shards(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
