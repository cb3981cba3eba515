"""Operator 9: mixing sources to target weights by systematic sampling.

A source's documents stand in one order (size, then id). Each has the same
expected number of copies, the source's target over its size; the prefix sum
of the expected copies plus one random offset of the source crosses an
integer as often as the document is taken. The order by size makes the words
taken differ from the target by no more than about one largest document.

Prefix sums run over range-partitioned blocks with offsets from the blocks'
counts, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairnet.llm.common import nested, parts_for, quoted
from pairnet.session import checkpoint

#: What a word is: a run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
BLOCK_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_of(source: Column, seed: str = SEED) -> Column:
    """A source's random offset in [0, 1), the same in every run."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``n_docs``, ``target`` of each source.

    Sources by code point (null last) take ``weights`` in turn and share
    ``share`` of all words; none gets over ``most`` times its size, the excess
    going to the others by weight. The level at which that settles follows
    from the sources sorted by cap over weight. One row per source is ranked
    in one task; nothing else is."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "place")
    per = per.select("*", place.alias("place"), w.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap"))
    per = per.select("*", (F.sum("source_size").over(whole) * F.lit(share)).alias("budget"),
                     (F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("below"),
                     F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("open_w"))
    per = per.withColumn("full", F.col("cap") * F.col("open_w") <= F.col("w") * (F.col("budget") - F.col("below")))
    used = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole)
    rest = F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(whole)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * ((F.col("budget") - used) / rest))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST,
         seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id``, ``source``, ``size``, ``source_size``,
    ``target``, ``copies``, ``taken``.

    A null or blank text has size 0 (and may still be taken). Null sources are
    one source, the last. Rows with equal ids and sizes are told apart by
    their place alone; null ids sort first. Other columns are ignored; an
    empty table gives an empty result."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(source_col).cast("string").alias("source"),
                       word_count(quoted(text_col).cast("string")).alias("size"))
    rows = checkpoint(rows, "sizes")  # the texts are read once
    goal = checkpoint(targets(rows, weights, share, most), "targets")  # one row per source
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id")]
    ranged = checkpoint(rows.repartitionByRange(parts_for(rows.count(), BLOCK_ROWS, 8), *order)
                        .withColumn("block", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per source and block.
    base = counts.select("source", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = base.join(goal, base["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    inside = Window.partitionBy("block", "source").orderBy("size", "doc_id")
    placed = ranged.withColumn("place", F.row_number().over(inside))
    b = base.withColumnRenamed("source", "_s").withColumnRenamed("block", "_b")
    placed = placed.join(b, (F.col("block") == F.col("_b")) & F.col("source").eqNullSafe(F.col("_s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = (F.col("base") + F.col("place")).cast("double")
    u = offset_of(F.col("source"), seed)
    copies = (F.floor(rank * rate + u) - F.floor((rank - 1) * rate + u)).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, plan_: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as ``plan_`` takes it.

    Rows that agree in id, source and size share their copies: the first of
    them (by text) get one more where the number isn't even."""
    per = plan_.groupBy("doc_id", "source", "size") \
        .agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    own = nested(docs, own_id=quoted(id_col).cast("long"), own_source=quoted(source_col).cast("string"),
                 own_size=word_count(quoted(text_col).cast("string")), own_text=quoted(text_col).cast("string"))
    joined = own.join(per, F.col("own_id").eqNullSafe(F.col("doc_id")) & F.col("own_source").eqNullSafe(F.col("source"))
                      & (F.col("own_size") == F.col("size")))
    nth = F.row_number().over(Window.partitionBy("own_id", "own_source", "own_size").orderBy("own_text"))
    take = F.floor(F.col("copies") / F.col("rows")) + F.when(nth <= F.col("copies") % F.col("rows"), 1).otherwise(0)
    counted = joined.withColumn("take", take.cast("int")).where("take > 0")
    return counted.select("doc", F.explode(F.sequence(F.lit(1), F.col("take")))).select("doc.*")
