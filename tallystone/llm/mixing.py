"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Each source has a weight and a cap of ``max_epochs`` times its size. Targets start in
proportion to the weights; what a capped source cannot take goes to the others by their
weights, until none is above its cap. A source then takes every document
``floor(target / size)`` times, and the fraction left from its documents in a seeded random
order, the last of them in part, so that its words meet the target to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, staged

#: Characters of the seeded hash that pick one of 4,096 buckets of a source.
BUCKET = 3


def word_count(text: Column) -> Column:
    """Words (maximal runs without ASCII white space) of a text; 0 for null."""
    spaced = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(F.length(spaced), F.lit(0)) == 0, 0).otherwise(F.size(F.split(spaced, " +"))).cast("long")


def source_ranks(sizes: DataFrame) -> DataFrame:
    """Number the sources from 0 by code point, null last.

    The table is range-partitioned and numbered within each partition; one row per
    partition goes to the driver, so no task ever sorts all sources.
    """
    placed = staged(sizes.repartitionByRange(F.col("src").asc_nulls_last()).sortWithinPartitions(F.col("src").asc_nulls_last()).withColumn("spot", F.monotonically_increasing_id()), "ranks")
    # the high bits of the number are the partition, in the order of the sources
    part = F.shiftright("spot", 33)
    offsets, total = {}, 0
    for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        offsets[r["p"]] = total
        total += r["n"]
    if not offsets:
        return placed.withColumn("rank", F.lit(0).cast("long")).drop("spot")
    table = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    return placed.withColumn("rank", table[part] + F.col("spot").bitwiseAND(2**33 - 1)).drop("spot")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Add ``target`` to a table with ``source_size`` and ``weight``.

    Each round takes the level (what is left over the weights that are open) and closes the
    sources whose cap lies below it. The level only rises, so the rounds end; each is one
    aggregate over the sources, and two numbers reach the driver. With the level known,
    a target is the lesser of cap and weight times level.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        open_ = cap > F.col("weight") * level if level >= 0 else F.lit(True)
        closed, weight = sources.agg(F.sum(F.when(~open_, cap)), F.sum(F.when(open_, F.col("weight")))).first()
        if not weight:
            break
        new = (total - (closed or 0.0)) / weight
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(max(level, 0.0))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: int = 3, seed: int = 42, with_key: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: id, ``size`` in words, ``source_size``, ``target`` (its source's) and ``taken``.

    ``weights`` repeat over the sources in code point order, null last. The random order is
    the SHA-256 of seed and id; equal ids are ordered by size, and rows alike in both are
    exchangeable, so reruns agree. Null ids, sources and texts are ordinary values (a null
    text has size 0). A source of size 0 takes nothing. An empty table gives an empty result.
    Other columns are not read.

    Scale: texts are read once, to a staged table of sizes. The cumulative sum within a source runs over 4,096 hash buckets, so a source
    with a third of all rows is spread evenly and no row-level window spans a source.
    """
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = staged(docs.select(F.xxhash64(*(with_key or (id_col,))).alias("key"), F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(F.col(text_col)).alias("size"), key.alias("h")), "sizes")
    bucketed = rows.withColumn("b", F.substring("h", 1, BUCKET))
    buckets = bucketed.groupBy("src", "b").agg(F.sum("size").alias("b_size"))
    sizes = buckets.groupBy("src").agg(F.sum("b_size").alias("source_size"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = source_ranks(sizes).withColumn("weight", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int")))
    targets = staged(water_fill(ranked, max_epochs).select("src", "source_size", "target"), "targets")
    # whole repetitions of every document, and how many words the fraction still takes
    plan = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target"), 6) / F.col("source_size"))).otherwise(0).cast("long")).withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")))
    up_to = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("before", F.coalesce(F.sum("b_size").over(up_to), F.lit(0)))
    placed = offsets.join(plan, offsets["src"].eqNullSafe(plan["src"])).select(offsets["src"].alias("s2"), F.col("b").alias("b2"), "before", "source_size", "target", "whole", "rest")
    joined = bucketed.join(placed, bucketed["src"].eqNullSafe(placed["s2"]) & (bucketed["b"] == placed["b2"]))
    within = Window.partitionBy("src", "b").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    extra = F.when(F.col("whole") < max_epochs, part).otherwise(0)
    return joined.select(*["key"] * bool(with_key), F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; a repetition taken in part counts if it is half or more.

    Rows alike in all columns are exchangeable; any other row keeps its own columns, whatever it shares with others. Null
    ids, sources and texts are ordinary values, rows without words are never taken, an empty table stays empty, columns of any name
    pass through (maps, which have no hash, don't tell rows apart). Texts are shuffled once, by a hash of the row.
    """
    hashed = [c for c, t in docs.dtypes if "map<" not in t and t != "variant"]
    key, times, own = fresh(docs.columns, "key", "times", "own")
    taken = mix(docs, id_col, text_col, source_col, with_key=tuple(hashed), **options)
    often = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")
    copies = taken.groupBy(F.col("key").alias(key), F.col(id_col).alias(own)).agg(F.sum(often).cast("int").alias(times)).where(F.col(times) > 0)
    keyed = docs.withColumn(key, F.xxhash64(*hashed))
    one = keyed.join(copies, (keyed[key] == copies[key]) & keyed[id_col].eqNullSafe(copies[own])).select(*[keyed[c] for c in keyed.columns], times)
    one = one.dropDuplicates([key, id_col])
    return one.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*docs.columns)
