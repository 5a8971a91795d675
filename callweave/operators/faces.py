"""Facial time series: smile baseline, windows of time, nods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fixed


def smile(left: Column, right: Column) -> Column:
    """Mean of both sides; a missing side is zero."""
    return (F.coalesce(left, F.lit(0.0)) + F.coalesce(right, F.lit(0.0))) / 2


def head_pitch(matrix: Column) -> Column:
    """Degrees of the head's pitch from a 4x4 transformation (array of rows)."""
    return F.degrees(F.atan2(matrix[2][1], matrix[2][2]))


def _around(seconds: float):
    """Samples within so many seconds, by whole microseconds."""
    reach = round(seconds * 1_000_000)
    return Window.partitionBy("recording_id").orderBy(F.round(F.col("t") * 1_000_000).cast("long")).rangeBetween(-reach, reach)


def smile_baseline(samples: DataFrame) -> DataFrame:
    """(recording_id, detected, total, smile_mean, smile_sd): zeros below ten detections."""
    n = F.count("smile")
    return samples.groupBy("recording_id").agg(
        n.alias("detected"), F.count("*").alias("total"), F.when(n >= 10, F.avg("smile")).otherwise(0.0).alias("smile_mean"), F.when(n >= 10, F.stddev_pop("smile")).otherwise(0.0).alias("smile_sd")
    )


def smile_bins(samples: DataFrame, *, seconds: int = 30, least: int = 20, top: int | None = 10) -> DataFrame:
    """(recording_id, bin, n, mean_smile[, place]): tumbling windows; ties rank the later bin first."""
    bins = samples.filter("smile is not null").groupBy("recording_id", F.floor(F.col("t") / seconds).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("smile").alias("mean_smile")).filter(F.col("n") >= least)
    if top is None:
        return bins
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("mean_smile"), F.desc("bin")))
    return bins.withColumn("place", nth.cast("long")).filter(F.col("place") <= top)


def smile_z(samples: DataFrame, *, window: float = 4.0) -> DataFrame:
    """Samples with the z-score of the mean smile within ``window`` seconds around them."""
    near = _around(window / 2)
    joined = samples.withColumn("near", F.avg("smile").over(near)).join(smile_baseline(samples).select("recording_id", "smile_mean", "smile_sd"), "recording_id")
    return joined.withColumn("z", F.when(F.col("smile_sd") >= 1e-9, (F.col("near") - F.col("smile_mean")) / F.col("smile_sd"))).drop("near", "smile_mean", "smile_sd")


def nods(samples: DataFrame, *, window: float = 2.0, amplitude: float = 1.5, reversals: int = 3) -> DataFrame:
    """Samples with ``nodding``: whether the head's pitch turns often enough within ``window`` seconds."""
    near = _around(window)
    point = F.when(F.col("pitch_deg").isNotNull(), F.struct("t", "pitch_deg"))
    listed = samples.withColumn("points", F.array_sort(F.collect_list(point).over(near)))
    zero = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("way"), F.lit(0).alias("turns"))

    def fold(s, p):
        delta = p["pitch_deg"] - s["last"]
        moved = s["last"].isNotNull() & (F.abs(delta) >= F.lit(float(amplitude)))
        way = F.when(moved, F.when(delta > 0, 1).otherwise(-1)).otherwise(s["way"])
        turned = moved & (s["way"] != 0) & (way != s["way"])
        return F.struct(p["pitch_deg"].alias("last"), way.alias("way"), (s["turns"] + turned.cast("int")).alias("turns"))

    turns = F.aggregate("points", zero, fold, lambda s: s["turns"])
    return listed.withColumn("nodding", (F.size("points") >= reversals + 2) & (turns >= reversals)).drop("points")


def tag(z: Column, nodding: Column) -> Column:
    bits = F.concat_ws(" · ", F.when(F.abs(z) >= 0.75, F.concat(F.lit("smile "), fixed(z, 1, "+"), F.lit("σ"))), F.when(nodding, "nodding"))
    return F.when(bits == "", "").otherwise(F.concat(F.lit("{"), bits, F.lit("}")))


def report(samples: DataFrame) -> DataFrame:
    """(recording_id, text): detection counts, the baseline and the warmest windows."""
    from .transcript import short_clock

    base, bins = smile_baseline(samples), smile_bins(samples)
    at = (F.col("bin") * 30).cast("long")
    line = F.concat(F.lit("  ["), short_clock(at), F.lit("-"), short_clock(at + 30), F.lit("]  "), fixed(F.col("mean_smile"), 3), F.when(F.col("nodding"), " + nodding").otherwise(""))
    middle = nods(samples).select("recording_id", (F.col("t") - 15).alias("at"), "nodding")
    marked = bins.join(middle, (bins["recording_id"] == middle["recording_id"]) & (F.col("bin") * 30.0 == F.col("at")), "left").select(bins["recording_id"], "place", "bin", "mean_smile", F.coalesce("nodding", F.lit(False)).alias("nodding"))
    listed = marked.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    head = F.concat(F.lit("facial affect track: "), F.col("recording_id").cast("string"), F.lit("\nface detected in "), F.col("detected").cast("string"), F.lit("/"), F.col("total").cast("string"),
                    F.lit(" frames; baseline smile "), fixed(F.col("smile_mean"), 3), F.lit(" (sd "), fixed(F.col("smile_sd"), 3), F.lit(")\n\nwarmest 30s windows (mean raw smile vs baseline):\n"))
    rows = base.join(listed, "recording_id", "left")
    return rows.select("recording_id", F.concat(head, F.coalesce(F.array_join(F.transform("lines", lambda x: F.concat(x["line"], F.lit("\n"))), ""), F.lit(""))).alias("text"))
