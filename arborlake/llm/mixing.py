"""Mixes sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source fall into blocks by a keyed hash, so each block is a random draw of the source. A source's
quota counts the blocks that the mix takes of it, repeats included. The tree deals exact quotas to the output
shards: a node draws its left half's share of every source without replacement and leaves the rest to the right
half. Every shard walks down from the root by itself, with random numbers that belong to the node, so shards agree
without talking to each other. Shards then own disjoint stretches of each source's permuted block draws.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from arborlake.runtime import materialize

#: Words and documents of a block on average, and block draws of a shard.
BLOCK_WORDS, BLOCK_DOCS, SHARD_DRAWS = 200_000, 5_000, 8
WORD = r"[^\x20\x09-\x0D]+"


def source_key(source: Column) -> Column:
    """Never null, so that sources can be joined by equality; null sorts after all others."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Adds ``target`` to rows (key, size), one for each source.

    Sources in order of their key weigh ``weights``, repeating, and share the sum of all sizes; no target is over
    ``most`` times its size, and what that cuts off is shared by weight among the others. Sorted by the level
    at which each source is full, the first that stays below it fixes the level of all behind it.
    """
    by_key, by_full = W.orderBy("key"), W.orderBy("full", "key")
    before, on = by_full.rowsBetween(W.unboundedPreceding, -1), by_full.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy()
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(by_key) - 1) % len(weights))
    cap = F.lit(most) * F.col("size")
    level = ((F.sum("size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
             / F.sum("weight").over(on))
    return (sources.withColumn("weight", weight).withColumn("full", cap / F.col("weight"))
            .withColumn("level", level)
            .withColumn("level", F.max(F.when(F.col("full") > F.col("level"), F.col("level"))).over(every))
            .withColumn("target", F.least(cap.cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))))
            .drop("weight", "full", "level"))


def shard_quotas(quotas: list[int], shard: int, depth: int, seed: int) -> list[tuple[int, int]]:
    """(first draw, number of draws) of each source that a shard gets; its ancestors split the quotas."""
    import numpy as np

    have, first = np.array(quotas, dtype=np.int64), np.zeros(len(quotas), np.int64)
    node = 1
    for level in range(depth - 1, -1, -1):
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(have, int(have.sum()) // 2, method="marginals")
        if shard >> level & 1:
            first, have, node = first + left, have - left, 2 * node + 1
        else:
            have, node = left, 2 * node
    return list(zip(first.tolist(), have.tolist()))


def _deal(depth: int, seed: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, quotas in zip(batch.column("shard").to_pylist(), batch.column("quotas").to_pylist()):
                rows = [(q["key"], shard, first, n) for q, (first, n) in
                        zip(quotas, shard_quotas([q["n"] for q in quotas], shard, depth, seed)) if n]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["key", "shard", "first", "n"])
    return run


def _fill(frame):
    """Of a block of which a part is wanted, documents in permuted order that still fit; the last may overshoot
    if that comes nearer."""
    import pandas as pd

    left = frame["wanted"].iloc[0]
    rows = frame.groupby("h", sort=True)["size"].sum()
    chosen, passed = [], []
    for h, size in rows.items():
        if size <= left:
            chosen.append(h)
            left -= size
        else:
            passed.append((size, h))
    if passed and min(passed)[0] < 2 * left:
        chosen.append(min(passed)[1])
    return pd.DataFrame({"key": frame["key"].iloc[0], "h": pd.Series(chosen, dtype="int64")})


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with ``mix``: size, source_size, target, h and draws (shard, copy).

    ``size`` counts words (null: 0); ``draws`` has an entry for each time that the mix takes the row, ``most`` at
    most. Each source comes within about half a document of its target. A null source is a source of its own, last
    in order; rows with equal ids share a place in the permutation, and repeated rows are taken together. Rows
    without words may be drawn and add nothing. An empty table gives no rows.
    """
    columns = [F.col(c) for c in docs.columns]
    row = docs.select(F.struct(*columns).alias("row"), source_key(F.col(source_col)).alias("key"),
                      F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
                      F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    narrow = materialize(row.select("key", "h", "size"), "sizes")

    sources = narrow.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
    sources = targets(sources, weights, most).withColumn("blocks", F.greatest(
        F.lit(1), F.ceil(F.col("size") / BLOCK_WORDS), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("long"))
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("int")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("size"))
    sources = materialize(sources.withColumnRenamed("size", "source_size"), "sources")

    block = F.floor(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) * F.col("blocks"))
    order = W.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "block"), "block")
    blocks = (narrow.join(sources, "key").withColumn("block", block)
              .groupBy("key", "block", "whole", "rest").agg(F.sum("size").alias("words"))
              .withColumn("wanted", F.col("rest") - F.coalesce(
                  F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("part", (F.col("wanted") > 0) & (F.col("wanted") < F.col("words")))
              .withColumn("draws", F.col("whole") + (F.col("wanted") > 0).cast("int")))
    blocks = materialize(blocks.select("key", "block", "whole", "wanted", "part", "draws"), "blocks")

    ordinal = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "block", "copy"), "block", "copy"))
    drawn = (blocks.filter("draws > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)))
             .select("key", "block", "copy", (ordinal - 1).cast("long").alias("ordinal")))
    depth = max(0, ((blocks.agg(F.sum("draws")).first()[0] or 0) // SHARD_DRAWS).bit_length() - 1)
    quotas = (blocks.groupBy("key").agg(F.sum("draws").alias("n")).groupBy()
              .agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("quotas"))  # a row for each source
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit((1 << depth) - 1)))))
    dealt = (quotas.mapInArrow(_deal(depth, seed), "key string, shard int, first long, n long")
             .select("key", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("ordinal")))
    dealt = (drawn.join(dealt, ["key", "ordinal"]).groupBy("key", "block")
             .agg(F.array_sort(F.collect_list(F.struct("shard", "copy"))).alias("draws")))  # most + 1 at most
    placed = materialize(blocks.drop("draws").join(dealt, ["key", "block"]), "draws")

    located = narrow.filter("size > 0").join(sources.select("key", "blocks"), "key").withColumn("block", block)
    # A block of each source at most, so a group is bounded by what a block holds.
    chosen = (located.join(placed.filter("part").select("key", "block", "wanted"), ["key", "block"])
              .select("key", "h", "size", "wanted").groupBy("key").applyInPandas(_fill, "key string, h long"))
    chosen = chosen.withColumn("chosen", F.lit(True))

    full = (row.join(sources.select("key", "source_size", "target", "blocks"), "key").withColumn("block", block)
            .join(placed, ["key", "block"], "left").join(chosen, ["key", "h"], "left"))
    draws = F.when(F.col("part") & F.col("chosen").isNull(), F.filter("draws", lambda d: d["copy"] < F.col("whole"))).otherwise(F.col("draws"))
    none = F.array().cast("array<struct<shard:int,copy:int>>")
    return full.select("row.*", F.struct("size", "source_size", "target", "h", F.coalesce(draws, none).alias("draws")).alias("mix"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 42, shuffle: bool = True,
        **columns) -> DataFrame:
    """The mixed rows: each row of ``docs`` once for every draw, with ``mix`` (shard, copy).

    With ``shuffle`` the rows of a shard lie in one partition, in a random order of their own.
    """
    planned = plan(docs, weights, most, seed, **columns)
    out = planned.withColumn("mix_draw", F.explode("mix.draws"))
    if shuffle:
        out = (out.repartition("mix_draw.shard")
               .sortWithinPartitions("mix_draw.shard", F.xxhash64(F.lit(seed), "mix_draw.shard", "mix_draw.copy", "mix.h")))
    return out.withColumn("mix", F.col("mix_draw")).drop("mix_draw")
