"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source expects target / source size copies. Documents of a source are put in an order (by size,
so that every stretch of the order has documents of all kinds in proportion), the expected copies are summed up along
it, one random offset is added, and a document is emitted once per integer boundary that its stretch crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, distributed_rank, documents, materialize


def water_filled(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): shares of the total size by weight, none above most x size.

    What is above is shared again by weight among the rest. With sources in the order of size / weight the capped ones
    come first, so running sums give the level at which all others stand.
    """
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(most))
    ranked = sources.withColumn("_cap", cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # the level seen at the first source that is not capped is the one at which all from there on stand
    ranked = ranked.withColumn("_level", level)
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(Window.partitionBy())
    target = F.when(first.isNull(), F.col("_cap")).otherwise(F.least("_cap", first["_level"] * F.col("weight")))
    return ranked.withColumn("target", target).drop("_cap", "_ratio", "_level")


def _words() -> Column:
    return F.coalesce(F.expr(f"regexp_count(text, r'{WORD}')"), F.lit(0)).cast("long")


def _identity() -> list[Column]:
    text = F.col("text").cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _words().alias("size"), F.xxhash64(text).alias("mark")]


def mix(docs: DataFrame, seed: int = 7, most: int = 3, cycle: int = 3, cell_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, source, size, mark, source_size, target, copies) of every row of ``docs`` (doc_id, text, source).

    size is the number of words (null text: 0). Sources in code point order, null last, weigh 1, 2, ... ``cycle``,
    repeating. A source without words has target 0. The order within a source, and so the result, depends only on
    doc_id, size, ``seed`` and ``mark``, a hash of the text that tells rows apart which share a doc_id, at any number of
    rows; rows alike in all of these are interchangeable. Other columns are ignored.
    """
    sized = materialize(docs.select(*_identity()), "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = (F.pmod(place - 1, F.lit(cycle)) + 1).cast("double")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("double") / (1 << 20)
    plan = water_filled(totals.withColumn("weight", weight), most).select(F.col("source").alias("_source"), "source_size", "target", offset.alias("_offset"))
    lots = 1 + sized.count() // cell_rows
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    cells = sized.withColumn("_draw", draw).withColumn("_size", F.floor(F.log2(F.col("size") + 1.0) * 8).cast("int"))
    # lots are ranges of the draw within one size, so cells follow the order of the rows however many there are
    cells = cells.withColumn("_lot", F.shiftright(F.conv(F.substring("_draw", 1, 8), 16, 10).cast("long") * F.lit(lots), 32))
    ranked = distributed_rank(cells, ["source"], ["_size", "size", "_lot"], [F.col("_draw"), F.col("doc_id"), F.col("mark")], "_rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(F.col("_rank") * rate + F.col("_offset")) - F.floor((F.col("_rank") - 1) * rate + F.col("_offset"))
    return ranked.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "size", "mark", "source_size", "target", copies.cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows that the mix takes, each as often as it takes them, with all their columns.

    Rows that repeat a doc_id count as one draw each. Rows alike in doc_id, source and text are numbered, so that each
    finds its own copies.
    """
    key = F.struct("doc_id", F.coalesce("size", F.lit(0).cast("long")).alias("size"), "source", F.coalesce("mark", F.lit(0).cast("long")).alias("mark")).alias("key")
    copies = F.sort_array(F.collect_list("copies"), asc=False).alias("copies")
    plan = mix(docs, seed).where("copies > 0").select(key, F.col("copies").cast("int").alias("copies")).groupBy("key").agg(copies)
    # the whole row travels as one value, so that no column of it can clash; it is shuffled once, by its key
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.struct(*_identity()).alias("key"))
    rows = rows.select("row", F.struct("key.doc_id", "key.size", "key.source", "key.mark").alias("key"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))))
    taken = rows.join(plan, "key").select("row", F.get("copies", F.col("turn") - 1).alias("n")).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op9_mixing(spark, sf_dir):
    found = mix(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents
), totals as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from sized group by source
), weighed as (
  select *, ((place - 1) % 3 + 1)::double as weight, source_size * 3.0::double as cap, source_size * 3.0::double / ((place - 1) % 3 + 1)::double as ratio,
         sum(source_size::double) over () as total from totals
), leveled as (
  select *, (total - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
            / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from weighed
), plan as (
  select source, source_size, least(cap, (select arg_min(level, ratio) from leveled where level <= ratio) * weight) as target,
         ('0x' || substr(md5('7:' || coalesce(source, '')), 1, 5))::bigint::double / 1048576 as start from leveled
), ranked as (
  select *, row_number() over (partition by source order by floor(log2(size + 1.0::double) * 8), size, md5('7:' || coalesce(doc_id::varchar, '')), doc_id) as place from sized
)
select doc_id, size, source_size, target,
  (size * (floor(place * (case when source_size > 0 then target / source_size else 0 end) + start) - floor((place - 1) * (case when source_size > 0 then target / source_size else 0 end) + start)))::bigint as taken
from ranked join plan on ranked.source is not distinct from plan.source
"""
