"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into source blocks by a hash of their content; shard sizes are the row count divided evenly
(at most one apart). How many rows each block sends to each shard is drawn exactly: the blocks are
halved again and again, and the shard totals of a half are a multivariate hypergeometric draw from
those of the whole (one conditional hypergeometric draw a shard, by inversion around the mode). Within
a block the rows are permuted by a keyed hash and cut by its line of the matrix; after the exchange they
are permuted again within their shard. DataFrame operations only; every random number is a hash of
(seed, place), so a lost task repeats the same draw.

Slots are dealt in buckets of random keys within a shard, each ranked on its own and offset by the counts
before it: no shard is ever one task. Rows equal in every column are interchangeable; they share a
block unless they are more than a block holds. Nulls hash like any value. An empty table gives no rows. Columns named ``shard`` or ``slot``
(in any case) are replaced; the others travel in a struct, so no name clashes with those used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

_TWO53 = float(1 << 53)


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) by a hash of its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(_TWO53)


def _draws(seed: int) -> str:
    """SQL: how many of ``draws`` rows go to each entry of ``caps``; sum(caps) >= draws.

    Entry by entry: k of the entry's K among N left when n are drawn. Weights relative to the mode m
    follow the ratio of neighbouring probabilities; eleven standard deviations (and twelve more) are
    summed on either side, beyond which doubles have no weight left.
    """
    up = "(cast(x.good - k as double) * (x.take - k)) / (cast(k + 1 as double) * (x.pop - x.good - x.take + k + 1))"
    down = "(cast(k as double) * (x.pop - x.good - x.take + k)) / (cast(x.good - k + 1 as double) * (x.take - k + 1))"

    def walk(start: str, stop: str, step: int, ratio: str, state: str, then: str) -> str:
        return f"aggregate(if({start} {'<' if step > 0 else '>'} {stop}, sequence({start}, {stop} - {step}, {step}L), array()), {state}, (s, k) -> {then.format(w=f's.w * ({ratio})')})"

    total_up = walk("x.m", "x.hi", 1, up, "named_struct('w', 1d, 't', 1d)", "named_struct('w', {w}, 't', s.t + {w})")
    total_down = walk("x.m", "x.lo", -1, down, "named_struct('w', 1d, 't', 0d)", "named_struct('w', {w}, 't', s.t + {w})")
    pick = "named_struct('w', {w}, 't', s.t + {w}, 'k', if(s.k is null and s.t + {w} > x.u, k + %d, s.k))"
    pick_up = walk("x.m", "x.hi", 1, up, "named_struct('w', 1d, 't', 1d, 'k', if(x.u < 1d, x.m, cast(null as bigint)))", pick % 1)
    pick_down = walk("x.m", "x.lo", -1, down, "named_struct('w', 1d, 't', y.t, 'k', y.k)", pick % -1)
    let = "element_at(transform(array({value}), {name} -> {body}), 1)"
    number = (
        "named_struct('pop', a.left_rows, 'good', caps[i], 'take', a.left_draws, "
        "'m', cast(floor((cast(a.left_draws + 1 as double) * (caps[i] + 1)) / (a.left_rows + 2)) as bigint), "
        "'q', cast(12 + 11 * sqrt(cast(a.left_draws as double) * caps[i] / greatest(a.left_rows, 1) * (1 - cast(caps[i] as double) / greatest(a.left_rows, 1))) as bigint))"
    )
    lo, hi = "greatest(0L, z.take - (z.pop - z.good))", "least(z.take, z.good)"
    mode = f"least(greatest(z.m, {lo}), {hi})"
    bounded = f"named_struct('pop', z.pop, 'good', z.good, 'take', z.take, 'm', {mode}, 'lo', greatest({lo}, {mode} - z.q), 'hi', least({hi}, {mode} + z.q), 'i', i)"
    with_u = (
        "named_struct('pop', x.pop, 'good', x.good, 'take', x.take, 'm', x.m, 'lo', x.lo, 'hi', x.hi, 'u', "
        f"(shiftrightunsigned(xxhash64({seed}, level, node, x.i), 11) / {_TWO53}d) * (({total_up}).t + ({total_down}).t))"
    )
    chosen = let.format(value=pick_up, name="y", body=f"coalesce(y.k, ({pick_down}).k, x.m)")
    drawn = let.format(value=number, name="z", body=let.format(value=bounded, name="x", body=let.format(value=with_u, name="x", body=chosen)))
    step = let.format(
        value=drawn,
        name="g",
        body="named_struct('left_rows', a.left_rows - caps[i], 'left_draws', a.left_draws - g, 'out', concat(a.out, array(g)))",
    )
    start = "named_struct('left_rows', aggregate(caps, 0L, (p, q) -> p + q), 'left_draws', draws, 'out', cast(array() as array<bigint>))"
    return f"aggregate(sequence(0, size(caps) - 1), {start}, (a, i) -> {step}).out"


def communication_matrix(counts: DataFrame, caps: list[int], levels: int, seed: int) -> DataFrame:
    """(block, row): rows that each of the 2^levels blocks sends to each shard.

    ``counts`` has (block, n); the entries of ``caps`` sum to all n.
    """
    spark = counts.sparkSession
    now = spark.range(1).select(F.col("id").alias("node"), F.array(*(F.lit(c).cast("long") for c in caps)).alias("caps"))
    draw = _draws(seed)
    for level in range(1, levels + 1):
        half = counts.select(F.shiftright("block", levels - level).alias("child"), "n").groupBy("child").agg(F.sum("n").alias("n"))
        left = half.filter("child % 2 = 0").select(F.shiftright("child", 1).alias("node"), F.col("n").alias("draws"))
        both = now.join(left, "node", "left").select("node", "caps", F.coalesce("draws", F.lit(0).cast("long")).alias("draws"), F.lit(level).alias("level"))
        cut = both.select("node", "caps", F.expr(draw).alias("mine"))
        now = cut.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("mine").alias("caps")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(caps, mine, (c, m) -> c - m)").alias("caps")),
                )
            ).alias("c")
        ).select("c.node", "c.caps")
        now = checkpointed(now)
    return now.select(F.col("node").alias("block"), F.col("caps").alias("row"))


def keyed_rows(rows: DataFrame, seed: int, hot_rows: int) -> DataFrame:
    """(r, copy, h): the caller's columns in a struct, a number for each row and a hash of its content; written to the shared folder.

    Rows that are equal in every column share ``h``, unless there are more than ``hot_rows`` of them: those are told apart by
    their place in the table that was written.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("r")
    base = checkpointed(rows.select(own, F.monotonically_increasing_id().alias("copy")))
    keyed = base.select("r", "copy", F.xxhash64(F.to_json("r", {"ignoreNullFields": "false"}), F.lit(seed)).alias("h"))
    hot = checkpointed(keyed.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select("h", F.lit(True).alias("hot")))
    if not hot.isEmpty():
        keyed = keyed.join(hot, "h", "left").withColumn("h", F.when(F.col("hot"), F.xxhash64("h", "copy")).otherwise(F.col("h")))
    return keyed.select("r", "copy", "h")


def shard_of(place: str, matrix: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (with ``block`` and their place in it) with the shard that their block's line of the matrix sends them to."""
    ends = "aggregate(row, cast(array() as array<bigint>), (a, x) -> concat(a, array(x + coalesce(try_element_at(a, -1), 0L))))"
    lines = matrix.select("block", F.expr(ends).alias("ends"))
    return rows.join(lines, "block").withColumn("shard", F.expr(f"cast(size(filter(ends, e -> e <= {place})) as int)")).drop("ends")


def slotted(sent: DataFrame, buckets: int, seed: int) -> DataFrame:
    """``sent`` (with h and shard) with ``slot``, gapless from 0 in each shard, by a keyed permutation; dealt in buckets."""
    sent = sent.withColumn("key", F.xxhash64("h", F.lit(seed + 3))).withColumn("bucket", F.floor(uniform(F.col("h"), F.lit(seed + 4)) * buckets).cast("int"))
    sent = checkpointed(sent)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("offset"))
    again = Window.partitionBy("shard", "bucket").orderBy("key", "h")
    out = sent.withColumn("place", F.row_number().over(again) - 1).join(offsets, ["shard", "bucket"])
    return out.withColumn("slot", (F.col("offset") + F.col("place")).cast("long")).drop("key", "bucket", "place", "offset")


def even_sizes(total: int, n_shards: int) -> list[int]:
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def shuffle_into_shards(rows: DataFrame, n_shards: int, *, seed: int = 20_240_501, block_rows: int = 8192, bucket_rows: int = 4096) -> DataFrame:
    """``rows`` with ``shard`` (0 .. n_shards-1, sizes at most one apart) and ``slot`` (gapless from 0).

    The given columns are written once to the shared checkpoint folder: hand over the columns that tell
    rows apart, not whole texts.
    """
    columns = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    keyed = keyed_rows(rows.select(*(F.col(f"`{c}`") for c in columns)), seed, block_rows).select("r", "h")
    total = keyed.count()
    levels = max(0, (max(total, 1) - 1) // block_rows).bit_length()
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.lit(1 << levels)).cast("long"))
    counts = checkpointed(keyed.groupBy("block").agg(F.count("*").alias("n")))
    matrix = communication_matrix(counts, even_sizes(total, n_shards), levels, seed)
    local = Window.partitionBy("block").orderBy(F.xxhash64("h", F.lit(seed + 2)), "h")
    sent = shard_of("place", matrix, keyed.withColumn("place", F.row_number().over(local) - 1)).select("r", "h", "shard")
    return slotted(sent, max(1, -(-total // (n_shards * bucket_rows))), seed).select("r.*", "shard", "slot")
