"""Speaker timelines: run-length encoding, debouncing, gap bridging. Window functions only.

Observations are (recording_id, frame_index, kind, who) with kind ``name``, ``unknown`` or ``gap``
(then ``who`` is null). All steps share one partitioning by recording and one order by frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["recording_id", "run_no", "start", "end", "kind", "who"]


def observation_key(name: Column, raw: Column) -> tuple[Column, Column]:
    """(kind, who) of a matched name, an unmatched label, or neither."""
    kind = F.when(name.isNotNull(), "name").when(raw.isNotNull(), "unknown").otherwise("gap")
    return kind, F.coalesce(name, raw)


def _order() -> Window:
    return Window.partitionBy("recording_id").orderBy("run_no")


def _merged(runs: DataFrame, begins: Column) -> DataFrame:
    """Runs joined to the last one that begins a group; kind and who are those of the group's first."""
    grouped = runs.withColumn("begins", begins).withColumn("run_no", F.sum(F.col("begins").cast("long")).over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    ordered = Window.partitionBy("recording_id", "run_no").orderBy("start", "end")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = grouped.withColumns({c: F.first(c).over(whole) for c in ("kind", "who")} | {"end": F.last("end").over(whole), "nth": F.row_number().over(ordered)})
    return firsts.filter("nth = 1").select(*RUN)


def runs(observations: DataFrame, fps: float = 2.0) -> DataFrame:
    """Runs of equal observations that follow each other; missing frames within a run are bridged."""
    w = Window.partitionBy("recording_id").orderBy("frame_index")
    change = F.coalesce(~(F.col("kind").eqNullSafe(F.lag("kind").over(w)) & F.col("who").eqNullSafe(F.lag("who").over(w))) | (F.row_number().over(w) == 1), F.lit(True))
    t = F.col("frame_index") / F.lit(float(fps))
    marked = observations.select("recording_id", "frame_index", "kind", "who", F.sum(change.cast("long")).over(w).alias("run_no"), t.alias("t"))
    return marked.groupBy("recording_id", "run_no").agg(
        F.min("t").alias("start"), F.max(F.col("t") + F.lit(1.0) / F.lit(float(fps))).alias("end"), F.min("kind").alias("kind"), F.min("who").alias("who")
    )


def debounce(runs_: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Takes runs shorter than ``seconds`` that follow one which is not a gap into their predecessor."""
    w = _order()
    before = F.lag("kind").over(w)
    drop = (F.col("kind") != "gap") & (F.col("end") - F.col("start") < F.lit(float(seconds))) & before.isNotNull() & (before != "gap")
    return _merged(runs_, ~drop)


def recollapse(runs_: DataFrame) -> DataFrame:
    """Joins neighbours of the same key."""
    w = _order()
    same = (F.col("kind") == F.lag("kind").over(w)) & F.col("who").eqNullSafe(F.lag("who").over(w))
    return _merged(runs_, ~F.coalesce(same, F.lit(False)))


def bridge(runs_: DataFrame, grace: float = 3.0) -> DataFrame:
    """Joins a named run, a gap shorter than ``grace`` and the same name after it."""
    w = _order()
    absorb = (
        (F.col("kind") == "gap") & (F.col("end") - F.col("start") < F.lit(float(grace)))
        & (F.lag("kind").over(w) == "name") & (F.lead("kind").over(w) == "name") & (F.lag("who").over(w) == F.lead("who").over(w))
    )
    marked = runs_.withColumn("absorb", F.coalesce(absorb, F.lit(False)))
    return _merged(marked, ~F.col("absorb") & ~F.coalesce(F.lag("absorb").over(w), F.lit(False)))


def spans(observations: DataFrame, *, fps: float = 2.0, debounce_seconds: float = 1.0, grace: float = 3.0) -> DataFrame:
    """(recording_id, span_no, start, end, name, raw_ocr, confidence, unresolved): the timeline without gaps."""
    done = bridge(recollapse(debounce(runs(observations, fps), debounce_seconds)), grace).filter("kind <> 'gap'")
    return done.select(
        "recording_id",
        F.row_number().over(_order()).cast("long").alias("span_no"),
        F.round("start", 3).alias("start"),
        F.round("end", 3).alias("end"),
        F.when(F.col("kind") == "name", F.col("who")).alias("name"),
        F.col("who").alias("raw_ocr"),
        F.lit(1.0).alias("confidence"),
        (F.col("kind") != "name").alias("unresolved"),
    )
