"""Delivery statistics of utterances: pitch, energy, pace, and their deviation from the speaker's own norm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fixed

FEATURES = ("f0_med", "f0_range", "f0_slope", "energy", "rate")


def utterance_windows(lines: DataFrame, *, longest: float = 15.0, shortest: float = 0.6) -> DataFrame:
    """(recording_id, line_no, t_start, t_end, label, text): each line until the next of any label."""
    following = F.lead("t").over(Window.partitionBy("recording_id").orderBy("line_no"))
    end = F.least((F.col("t") + F.lit(float(longest))).cast("double"), following.cast("double"))
    rows = lines.select("recording_id", "line_no", F.col("t").cast("double").alias("t_start"), end.alias("t_end"), "label", "text")
    return rows.filter(F.col("t_end") - F.col("t_start") >= F.lit(float(shortest)))


def rate(words: Column, seconds: Column) -> Column:
    """Words a second; null without words."""
    return F.when(words > 0, words / seconds)


def frames_of(utterances: DataFrame, frames: DataFrame, *, seconds: float = 15.0) -> DataFrame:
    """Frames within [t_start, t_end] of their utterance (same recording and channel).

    Both sides meet by stretches of ``seconds``, so a recording's frames are not paired with all of its utterances.
    """
    keys = [c for c in ("recording_id", "channel") if c in utterances.columns and c in frames.columns]
    stretch = lambda t: F.floor(F.col(t) / F.lit(float(seconds)))
    spread = utterances.select(*keys, "utt", "t_start", "t_end", F.explode(F.sequence(stretch("t_start"), stretch("t_end"))).alias("__stretch"))
    near = spread.join(frames.withColumn("__stretch", stretch("t")), [*keys, "__stretch"])
    return near.filter((F.col("t") >= F.col("t_start")) & (F.col("t") <= F.col("t_end"))).drop("t_start", "t_end", "__stretch")


def pitch_features(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f0_med, f0_range, voiced_frac) of frames (t, f0; null is unvoiced); at least eight voiced."""
    counted = frames.groupBy(*keys).agg(F.sort_array(F.collect_list("f0")).alias("f"), F.count("f0").alias("voiced"), F.count("*").alias("total"), F.median("f0").alias("mid"))
    n = F.col("voiced")
    low = F.element_at("f", (F.greatest(F.lit(0), F.floor(n * 0.1).cast("int") - 1) + 1).cast("int"))
    high = F.element_at("f", (F.least(n.cast("int") - 1, F.floor(n * 0.9).cast("int")) + 1).cast("int"))
    enough = n >= 8
    return counted.select(*keys, F.when(enough, F.col("mid")).alias("f0_med"), F.when(enough, high - low).alias("f0_range"), (n / F.greatest(F.lit(1), F.col("total"))).alias("voiced_frac"))


def _slope(points: Column) -> Column:
    """Least squares of ``f0`` over ``t`` by running moments in the order of time; zero without spread.

    A slope of exactly 20 is marked and one a last digit below is not; these steps give the last digits of the SQL's ``regr_slope`` in most cases.
    """
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("n", "t", "f", "both", "spread")))

    def fold(s, p):
        n, dt = s["n"] + 1, p["t"] - s["t"]
        t, f = s["t"] + dt / n, s["f"] + (p["f0"] - s["f"]) / n
        return F.struct(n.alias("n"), t.alias("t"), f.alias("f"), (s["both"] + dt * (p["f0"] - f)).alias("both"), (s["spread"] + (p["t"] - t) * dt).alias("spread"))

    return F.aggregate(F.array_sort(points), zero, fold, lambda s: F.when(s["spread"] > 0, (s["both"] / s["n"]) / (s["spread"] / s["n"])).otherwise(0.0))


def terminal_slope(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f0_slope): least squares over the last two fifths of the voiced frames, three at least."""
    w = Window.partitionBy(*keys)
    voiced = frames.filter("f0 is not null").withColumns({"nth": F.row_number().over(w.orderBy("t")) - 1, "n": F.count("*").over(w)})
    tail = voiced.filter((F.col("n") >= 8) & (F.col("nth") >= F.floor(F.col("n") * 0.6)))
    fitted = tail.groupBy(*keys).agg(F.collect_list(F.struct("t", "f0")).alias("points"))
    return fitted.select(*keys, F.when(F.size("points") >= 3, _slope(F.col("points"))).alias("f0_slope"))


def voiced_energy(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, energy): mean intensity from the first to the last voiced frame, of all frames without one."""
    w = Window.partitionBy(*keys)
    voiced = F.when(F.col("f0").isNotNull(), F.col("t"))
    marked = frames.withColumns({"lo": F.min(voiced).over(w), "hi": F.max(voiced).over(w)})
    inside = F.col("lo").isNull() | F.col("t").between(F.col("lo"), F.col("hi"))
    good = inside & ~F.isnan("intensity") & (F.col("intensity") != 0)
    return marked.groupBy(*keys).agg(F.avg(F.when(good, F.col("intensity"))).alias("energy"))


def utterance_features(frames: DataFrame, keys: list[str], extra: tuple[Column, ...] = ()) -> DataFrame:
    """(keys, extra, f0_med, f0_range, voiced_frac, f0_slope, energy) in one pass over the frames.

    The rules are those of ``pitch_features``, ``terminal_slope`` and ``voiced_energy``; ``extra`` are more
    aggregates of the same groups.
    """
    w = Window.partitionBy(*keys)
    spoken = F.col("f0").isNotNull()
    so_far = F.count("f0").over(w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    at = F.when(spoken, F.col("t"))
    marked = frames.withColumns({"n": F.count("f0").over(w), "nth": so_far - 1, "lo": F.min(at).over(w), "hi": F.max(at).over(w)})
    tail = spoken & (F.col("n") >= 8) & (F.col("nth") >= F.floor(F.col("n") * 0.6))
    heard = (F.col("lo").isNull() | F.col("t").between(F.col("lo"), F.col("hi"))) & ~F.isnan("intensity") & (F.col("intensity") != 0)
    made = marked.groupBy(*keys).agg(
        *extra, F.sort_array(F.collect_list("f0")).alias("f"), F.count("f0").alias("voiced"), F.count("*").alias("total"), F.median("f0").alias("mid"),
        F.collect_list(F.when(tail, F.struct("t", "f0"))).alias("points"), F.avg(F.when(heard, F.col("intensity"))).alias("energy"),
    )
    n = F.col("voiced")
    low = F.element_at("f", (F.greatest(F.lit(0), F.floor(n * 0.1).cast("int") - 1) + 1).cast("int"))
    high = F.element_at("f", (F.least(n.cast("int") - 1, F.floor(n * 0.9).cast("int")) + 1).cast("int"))
    kept = [c for c in made.columns if c not in ("f", "voiced", "total", "mid", "points", "energy")]
    return made.select(*kept, F.when(n >= 8, F.col("mid")).alias("f0_med"), F.when(n >= 8, high - low).alias("f0_range"), (n / F.greatest(F.lit(1), F.col("total"))).alias("voiced_frac"), F.when(F.size("points") >= 3, _slope(F.col("points"))).alias("f0_slope"), "energy")


def zscores(features: DataFrame, by: list[str], *, min_duration: float = 1.5, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """``features`` with z_* columns against the utterances of the same speaker.

    The norm is taken from utterances of ``min_duration``, or from all where fewer than three of them have
    the feature; three values and some spread are needed, else the score is null.
    """
    w = Window.partitionBy(*by)
    long = F.col("duration") >= F.lit(float(min_duration))
    out = features
    scores = {}
    for name in names:
        value, own = F.col(name), F.when(long, F.col(name))
        few = F.count(own).over(w) < 3
        mean = F.when(few, F.avg(value).over(w)).otherwise(F.avg(own).over(w))
        spread = F.when(few, F.stddev_pop(value).over(w)).otherwise(F.stddev_pop(own).over(w))
        scores[f"z_{name}"] = F.when((F.count(value).over(w) >= 3) & (spread > 1e-9), (value - mean) / spread)
    return out.withColumns(scores)


def tag(z: dict[str, Column], slope: Column) -> Column:
    """``{pitch +1.4σ · rising · energy +0.9σ}``, or an empty string."""
    shown = lambda name, label, least: F.when(F.abs(z[name]) >= least, F.concat(F.lit(f"{label} "), fixed(z[name], 1, "+"), F.lit("σ")))
    bits = F.concat_ws(
        " · ",
        shown("f0_med", "pitch", 0.5),
        F.when(F.abs(slope) >= 20, F.when(slope > 0, "rising").otherwise("falling")),
        shown("f0_range", "animation", 0.75),
        shown("energy", "energy", 0.75),
        shown("rate", "pace", 1.0),
    )
    return F.when(bits == "", "").otherwise(F.concat(F.lit("{"), bits, F.lit("}")))


def largest_z(names: tuple[str, ...] = FEATURES) -> Column:
    return F.greatest(*(F.abs(F.col(f"z_{n}")) for n in names))


def top_deviations(scored: DataFrame, by: list[str], order: str, n: int = 10, min_duration: float = 2.0) -> DataFrame:
    """The ``n`` utterances of each speaker that deviate most (ties: the earlier first).

    Deviations that differ by the rounding of their sums only, as those of two utterances equally far from the mean, are ties.
    """
    rows = scored.withColumn("deviation", largest_z()).filter(F.col("deviation").isNotNull() & (F.col("duration") >= F.lit(float(min_duration))))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("deviation", 9).desc(), order))
    return rows.withColumn("place", nth).filter(F.col("place") <= n)


def annotate(lines: DataFrame, tagged: DataFrame) -> DataFrame:
    """Lines with the tag of the last utterance that starts in the same second."""
    marks = tagged.groupBy("recording_id", F.bround("t_start").cast("long").alias("t")).agg(F.max_by("tag", "line_no").alias("tag"))
    return lines.join(marks, ["recording_id", "t"], "left").withColumn("tag", F.coalesce("tag", F.lit("")))


def vad_segments(frames: DataFrame, *, step: float, silence_bridge: float = 0.6, longest: float = 30.0, shortest: float = 0.8, order: str | None = None) -> DataFrame:
    """(recording_id, segment_no, t_start, t_end): voiced frames joined over short silences.

    A segment ends before a silence longer than ``silence_bridge`` or at ``longest``. Silences cut a
    recording into islands by a window; only within one of those is the sequential rule folded.
    """
    w = Window.partitionBy("recording_id").orderBy(*(["t"] + ([order] if order else [])))
    gap = F.coalesce(F.col("t") - F.lag("t").over(w) > F.lit(float(silence_bridge)), F.lit(True))
    islands = frames.withColumn("island", F.sum(gap.cast("long")).over(w))
    packed = islands.groupBy("recording_id", "island").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    one = "struct<a:double,b:double>"
    zero = F.struct(F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("prev"), F.array().cast(f"array<{one}>").alias("done"))

    def fold(s, t):
        fresh = s["start"].isNull()
        cut = ~fresh & (t - s["start"] > F.lit(float(longest)))
        keep = cut & (s["prev"] - s["start"] >= F.lit(float(shortest)))
        ended = F.array(F.struct(s["start"].alias("a"), (s["prev"] + F.lit(float(step))).alias("b")))
        return F.struct(F.when(fresh | cut, t).otherwise(s["start"]).alias("start"), t.alias("prev"), F.when(keep, F.concat(s["done"], ended)).otherwise(s["done"]).alias("done"))

    def finish(s):
        ended = F.array(F.struct(s["start"].alias("a"), (s["prev"] + F.lit(float(step))).alias("b")))
        return F.when(s["prev"] - s["start"] >= F.lit(float(shortest)), F.concat(s["done"], ended)).otherwise(s["done"])

    cut = packed.select("recording_id", F.explode(F.aggregate("ts", zero, fold, finish)).alias("s"))
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy("s.a")).cast("long")
    return cut.select("recording_id", nth.alias("segment_no"), F.col("s.a").alias("t_start"), F.col("s.b").alias("t_end"))
