"""Channel health: mean and peak level in decibels, and the verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE_FLOOR_DB = -55.0
SILENCE_DB = -91.0
FRACTIONS = (0.1, 0.3, 0.5, 0.7, 0.9)


def decibels(power):
    """10 log10 of a mean power; silence is minus infinity."""
    return F.when(power > 0, 10 * F.log10(power)).when(power.isNotNull(), F.lit(float("-inf")))


def channel_levels(samples: DataFrame, by: tuple[str, ...] = ("recording_id", "channel")) -> DataFrame:
    """(by, mean_db, max_db) of samples ``x``."""
    power = samples.groupBy(*by).agg(F.avg(F.col("x") * F.col("x")).alias("p"), F.max(F.abs("x")).alias("m"))
    return power.select(*by, decibels(F.col("p")).alias("mean_db"), decibels(F.col("m") * F.col("m")).alias("max_db"))


def sampled_levels(samples: DataFrame, durations: DataFrame, *, seconds: float = 12.0) -> DataFrame:
    """The best of five windows spread over a recording; all of it where it is shorter than two windows.

    ``samples`` have ``t`` in seconds, ``durations`` (recording_id, duration). Windows without signal are
    passed over; a channel without any other has -91 dB.
    """
    known = samples.join(durations, "recording_id")
    short = F.col("duration").isNull() | (F.floor("duration") < 2 * seconds)
    starts = F.when(short, F.array(F.lit(0.0))).otherwise(F.array(*(F.floor(F.floor("duration") * f).cast("double") for f in FRACTIONS)))
    wide = F.when(short, F.lit(float("inf"))).otherwise(F.lit(float(seconds)))
    # windows of short recordings overlap; a sample becomes a row for each window that holds it, and none otherwise
    holds = F.filter(starts, lambda s: (F.col("t") >= s) & (F.col("t") < s + F.col("wide")))
    rows = known.withColumns({"wide": wide, "full": short}).withColumn("start", F.explode(holds))
    each = channel_levels(rows, ("recording_id", "channel", "start", "full"))
    heard = each.filter(~((F.col("mean_db") == float("-inf")) & ~F.col("full"))).groupBy("recording_id", "channel").agg(F.max("mean_db").alias("mean_db"), F.max("max_db").alias("max_db"))
    every = samples.select("recording_id", "channel").distinct()
    return every.join(heard, ["recording_id", "channel"], "left").select("recording_id", "channel", F.coalesce("mean_db", F.lit(SILENCE_DB)).alias("mean_db"), F.coalesce("max_db", F.lit(SILENCE_DB)).alias("max_db"))


def levels_of_energy(energy: DataFrame) -> DataFrame:
    """(recording_id, channel, mean_db, max_db) of stretches of sound (``whole``, samples, energy, peak), which may come in pieces.

    A channel has the best of its stretches. Stretches without signal are passed over, but for those that are a whole file; a channel without any
    other has -91 dB.
    """
    keys = ["recording_id", "channel", "stretch", "whole"]
    sums = energy.groupBy(*keys).agg((F.sum("energy") / F.sum("samples")).alias("p"), F.max("peak").alias("m"))
    each = sums.select(*keys, decibels(F.col("p")).alias("mean_db"), decibels(F.col("m") * F.col("m")).alias("max_db"))
    heard = F.col("whole") | (F.col("mean_db") > float("-inf"))
    best = each.groupBy("recording_id", "channel").agg(*(F.max(F.when(heard, F.col(c))).alias(c) for c in ("mean_db", "max_db")))
    return best.select("recording_id", "channel", F.coalesce("mean_db", F.lit(SILENCE_DB)).alias("mean_db"), F.coalesce("max_db", F.lit(SILENCE_DB)).alias("max_db"))


def stretches(headers: DataFrame, forced: str | None = None, *, seconds: float = 12.0) -> DataFrame:
    """``headers`` of sound files (bytes, rate, frames, duration) with ``mode``, ``stretch``, ``whole``, ``first`` and ``count`` of frames: five
    windows of files that are to be sampled and last two windows or more, else all of the file."""
    whole_seconds = F.floor("duration")
    mode = scan_mode(F.col("bytes"), forced)
    few = (mode == "sampled") & (whole_seconds >= 2 * seconds)
    starts = F.array(*((F.floor(whole_seconds * f) * F.col("rate")).cast("long") for f in FRACTIONS))
    rows = headers.withColumns({"mode": mode, "whole": ~few}).select("*", F.posexplode(F.when(few, starts).otherwise(F.array(F.lit(0).cast("long")))).alias("stretch", "first"))
    length = F.when(F.col("whole"), F.col("frames")).otherwise(F.least(F.col("frames") - F.col("first"), (F.col("rate") * F.lit(float(seconds))).cast("long")))
    return rows.withColumn("count", length)


def verdicts(levels: DataFrame, floor_db: float = NOISE_FLOOR_DB) -> DataFrame:
    """``levels`` with OK or DEAD."""
    dead = F.col("mean_db").isNull() | (F.col("mean_db") == float("-inf")) | (F.col("mean_db") < F.lit(float(floor_db)))
    return levels.withColumn("verdict", F.when(dead, "DEAD").otherwise("OK"))


def overall(judged: DataFrame) -> DataFrame:
    """(recording_id, passed): whether all channels are OK."""
    return judged.groupBy("recording_id").agg(F.every(F.col("verdict") == "OK").alias("passed"))


def scan_mode(size_bytes, forced: str | None = None, limit: int = 1 << 30):
    """``sampled`` for files over ``limit`` bytes unless forced."""
    return F.lit(forced) if forced else F.when(size_bytes > limit, "sampled").otherwise("full")
