"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources are weighed in their order (by code point, null last) by the given weights, repeated; together they get ``share`` times
all sizes, and none more than ``most`` times its own: what is above that is shared again by weight among the others, until none
is above. A source's target, rounded, is its quota of words. Documents are cut into blocks of ``block_words`` words. A quota of
several times the source takes every block as often as it goes; for the rest the source's blocks stand in a keyed random order
and are taken from the front, the last one in part, so each quota is met to the word.

The blocks taken of each bucket of a source are an exact quota that is split among the output shards: the buckets are halved
again and again, and what the shards get of a half is a multivariate-hypergeometric draw from what they get of the whole. A bucket's
blocks, in another random order, are cut by its line of the matrix, so the draws are disjoint; within its shard every block gets
a slot by a third order. Shards are within one block of each other. DataFrame operations only; random numbers are hashes of (seed, content), so
reruns agree. Buckets are bounded: no source, shard or document is ever one task.

Nulls: a null source is a source of its own, a null or negative size is zero; documents of size zero are never taken. Rows equal in every column
are interchangeable. An empty table gives empty results. The caller's columns travel in a struct, so no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, numbered
from .shard import communication_matrix, even_sizes, keyed_rows, shard_of, slotted


def n_words(text: Column) -> Column:
    """The number of runs of characters other than space and U+0009 to U+000D; none in null."""
    marked = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (key, source_size, ...), in the order of their keys, with ``target``.

    Sources at their limit are found by a few sums over the table: the rate of words for each weight rises until no more sources reach it.
    """
    at = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("number") % len(weights) + 1).cast("int"))
    listed = checkpointed(numbered(sources, ["key"]).withColumn("weight", at).withColumn("limit", F.col("source_size") * F.lit(float(most))).drop("number", "total", "part"))
    rate, full = 0.0, -1
    while True:
        over = F.col("limit") <= F.col("weight") * F.lit(rate)
        sums = listed.agg(
            F.sum("source_size").alias("size"), F.sum(F.when(over, F.col("source_size"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("free"), F.count_if(over).alias("full")
        ).first()
        if not sums["free"] or sums["full"] == full:
            break
        full = sums["full"]
        rate = max(0.0, share * sums["size"] - most * (sums["held"] or 0)) / sums["free"]
    return listed.withColumn("target", F.least("limit", F.col("weight") * F.lit(rate))).drop("weight", "limit")


@dataclass(frozen=True)
class Mix:
    """``documents`` (row, r, size, source_size, target) of all rows and ``pieces`` (row, block, turn, first_word, words, shard, slot) of those taken;
    r has the columns handed over, ``first_word`` counts the document's words from 0."""

    documents: DataFrame
    pieces: DataFrame


def mix(rows: DataFrame, *, source: str = "source", size: str = "size", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, n_shards: int = 40, block_words: int = 512, bucket_blocks: int = 8192, seed: int = 20_240_613) -> Mix:
    """The mix of ``rows``. Their columns are written to the shared folder: hand over those that tell rows apart, not whole texts."""
    key = F.coalesce(F.concat(F.lit("0"), F.col(f"r.`{source}`").cast("string")), F.lit("1"))
    words = F.coalesce(F.greatest(F.col(f"r.`{size}`"), F.lit(0)), F.lit(0)).cast("long")
    keyed = keyed_rows(rows, seed, bucket_blocks).select("r", F.col("copy").alias("row"), "h", key.alias("key"), words.alias("size"))
    sources = keyed.groupBy("key").agg(F.sum("size").alias("source_size"), F.sum(F.ceil(F.col("size") / block_words)).alias("blocks"))
    aims = targets(checkpointed(sources), weights, share, most)
    quota = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.coalesce(F.expr("try_divide(quota, source_size)"), F.lit(0))
    aims = aims.withColumn("quota", quota).withColumn("whole", F.floor(whole).cast("int")).withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size"))
    aims = checkpointed(aims.withColumn("buckets", F.greatest(F.ceil(F.col("blocks") / bucket_blocks), F.lit(1)).cast("int")).drop("blocks", "quota"))

    documents = keyed.join(aims.select("key", "source_size", "target"), "key").select("row", "r", "size", "source_size", "target")
    each = keyed.filter("size > 0").join(aims.select("key", "whole", "rest", "buckets"), "key")
    each = each.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block_words) - 1)))
    blocks = each.select(
        "key", F.pmod(F.xxhash64("h", "block", F.lit(seed + 11)), F.col("buckets")).cast("int").alias("bucket"), "row", "h", "block",
        F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words).alias("words"), "whole", "rest",
    )
    blocks = checkpointed(blocks)

    # the rest of each quota: blocks from the front of their source's order, bucket after bucket
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("key", "bucket").agg(F.sum("words").alias("n")).select("key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    ahead = Window.partitionBy("key", "bucket").orderBy(F.xxhash64("h", "block", F.lit(seed + 10)), "h", "row", "block").rowsBetween(Window.unboundedPreceding, -1)
    drawn = blocks.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(starts, ["key", "bucket"])
    part = F.greatest(F.lit(0).cast("long"), F.least("words", F.col("rest") - F.col("start") - F.col("ahead")))
    turns = F.concat(F.array_repeat("words", F.col("whole")), F.filter(F.array(part), lambda p: p > 0))
    units = checkpointed(drawn.select("key", "bucket", "row", "h", "block", F.posexplode(turns).alias("turn", "words")))

    # exact quotas of buckets, split among the shards
    quotas = checkpointed(numbered(units.groupBy("key", "bucket").agg(F.count("*").alias("n")), ["key", "bucket"]))
    counts = quotas.select(F.col("number").alias("block"), "n")
    sums = counts.agg(F.sum("n").alias("units"), F.count("*").alias("blocks")).first()
    total = sums["units"] or 0
    matrix = communication_matrix(counts, even_sizes(total, n_shards), max(0, sums["blocks"] - 1).bit_length(), seed)
    order = Window.partitionBy("key", "bucket").orderBy(F.xxhash64("h", "block", "turn", F.lit(seed + 12)), "h", "row", "block", "turn")
    placed = units.withColumn("place", F.row_number().over(order) - 1).withColumnRenamed("block", "of")
    placed = placed.join(quotas.select("key", "bucket", F.col("number").alias("block")), ["key", "bucket"])
    sent = shard_of("place", matrix, placed).select("row", F.col("of").alias("block"), "turn", (F.col("of") * block_words).alias("first_word"), "words", "shard", F.xxhash64("h", "of", "turn").alias("h"))
    return Mix(documents, slotted(sent, max(1, -(-total // (n_shards * bucket_blocks))), seed).drop("h"))
