"""Speaker attribution of transcript lines: interval join, collapse, coverage, human review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _timed(lines: DataFrame, spans: DataFrame, lag: float, self_name: str, caller: str, stretch: float = 30.0) -> DataFrame:
    """``lines`` with ``timed``, the label by time.

    Spans are gathered by stretches of time, cut to the time that their recording has lines in; a line meets the few
    spans of its own stretch, so neither a recording is one row nor a pair of line and span.
    """
    at = F.col("t") - F.lit(float(lag))
    known = lines.groupBy("recording_id").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    place = lambda c: F.floor(c / stretch).cast("long")
    inside = spans.join(known, "recording_id").filter("start < end and start <= high and end > low")
    cut = F.sequence(place(F.greatest("start", "low")), place(F.least("end", "high")))
    pieces = inside.withColumn("stretch", F.explode(cut))
    near = pieces.groupBy("recording_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("span_no", "start", "end", "name"))).alias("spans"))
    first = F.try_element_at(F.filter("spans", lambda s: (s["start"] <= at) & (at < s["end"])), F.lit(1))["name"]
    good = (F.col("label") == caller) & first.isNotNull() & (first != "") & (first != self_name)
    joined = lines.withColumn("stretch", place(at)).join(near, ["recording_id", "stretch"], "left")
    return joined.select("recording_id", "line_no", "t", "label", "text", F.when(good, first).otherwise(F.col("label")).alias("timed"))


def relabel_timed(lines: DataFrame, spans: DataFrame, *, lag: float = 1.5, self_name: str = "You", caller: str = "Caller") -> DataFrame:
    """``lines`` with the label of the first span that holds ``t - lag``; ``original_label`` is kept.

    Only caller lines change, and only where that span has a name other than ``self_name``.
    """
    found = _timed(lines, spans, lag, self_name, caller)
    return found.select("recording_id", "line_no", "t", F.col("timed").alias("label"), "text", F.col("label").alias("original_label"))


def distinct_speakers(spans: DataFrame, self_name: str = "You") -> DataFrame:
    """(recording_id, others): the sorted names of a recording, without oneself."""
    name = F.when((F.col("name") != "") & (F.col("name") != self_name), F.col("name"))
    return spans.groupBy("recording_id").agg(F.array_sort(F.collect_set(name)).alias("others"))


def attribution_mode(recordings: DataFrame, spans: DataFrame, *, callers: int | None = None, self_name: str = "You") -> DataFrame:
    """(recording_id, mode, speaker, others, warning): ``collapse`` where one other speaker is all there is."""
    found = recordings.select("recording_id").distinct().join(distinct_speakers(spans, self_name), "recording_id", "left")
    found = found.withColumn("others", F.coalesce("others", F.array().cast("array<string>")))
    one = F.size("others") == 1
    collapse = one if callers in (None, 1) else F.lit(False)
    names = F.when(F.size("others") == 0, "none").otherwise(F.concat(F.lit("['"), F.array_join("others", "', '"), F.lit("']")))
    said = F.concat(F.lit("--callers 1 but "), F.size("others").cast("string"), F.lit(" named speakers detected ("), names, F.lit("); using timed attribution"))
    warning = F.when(~one, said) if callers == 1 else F.lit(None).cast("string")
    return found.select("recording_id", F.when(collapse, "collapse").otherwise("timed").alias("mode"), F.when(collapse, F.col("others")[0]).alias("speaker"), "others", warning.alias("warning"))


def collapse_caller(lines: DataFrame, speakers: DataFrame, caller: str = "Caller") -> DataFrame:
    """All caller lines get the speaker of their recording, where one is given."""
    joined = lines.join(speakers.select("recording_id", "speaker"), "recording_id", "left")
    label = F.when((F.col("label") == caller) & F.col("speaker").isNotNull(), F.col("speaker")).otherwise(F.col("label"))
    return joined.select("recording_id", "line_no", "t", label.alias("label"), "text", F.col("label").alias("original_label"))


def resolve(lines: DataFrame, spans: DataFrame, *, lag: float = 1.5, self_name: str = "You", caller: str = "Caller", callers: int | None = None) -> DataFrame:
    """``lines`` relabelled by collapse where a recording allows it, else by time."""
    found = _timed(lines, spans, lag, self_name, caller).join(distinct_speakers(spans, self_name), "recording_id", "left")
    collapse = F.size("others") == 1 if callers in (None, 1) else F.lit(False)
    label = F.when(collapse & (F.col("label") == caller), F.col("others")[0]).when(collapse, F.col("label")).otherwise(F.col("timed"))
    mode = F.when(collapse, "collapse").otherwise("timed")
    return found.select("recording_id", "line_no", "t", label.alias("label"), "text", F.col("label").alias("original_label"), mode.alias("mode"))


def coverage(lines: DataFrame, caller: str = "Caller") -> DataFrame:
    """(recording_id, caller_lines, attributed_lines, attributed_pct, lost_lines)."""
    theirs = F.col("original_label") == caller
    lost = theirs & (F.col("label") == caller)
    counted = lines.groupBy("recording_id").agg(
        F.count_if(theirs).alias("caller_lines"),
        F.count_if(theirs & ~lost).alias("attributed_lines"),
        F.array_sort(F.collect_list(F.when(lost, F.struct("line_no", "t", "text")))).alias("lost"),
    )
    pct = F.when(F.col("caller_lines") > 0, F.bround(F.col("attributed_lines") / F.col("caller_lines") * 100, 1)).otherwise(F.lit(0.0))
    return counted.select("recording_id", "caller_lines", "attributed_lines", pct.alias("attributed_pct"), F.transform("lost", lambda x: F.struct(x["t"], x["text"])).alias("lost_lines"))


# ---------------------------------------------------------------- review


def with_review_ids(spans: DataFrame) -> DataFrame:
    """``spans`` with a review id for each unmatched label, numbered by recording as they first appear.

    Windows within a recording only, so the timeline's partitioning is kept.
    """
    label = Window.partitionBy("recording_id", "raw_ocr", "unresolved")
    begins = F.col("unresolved") & (F.col("span_no") == F.min("span_no").over(label))
    nth = F.sum("begins").over(Window.partitionBy("recording_id").orderBy("span_no"))
    numbered = spans.withColumn("begins", begins.cast("int")).withColumn("nth", nth)
    number = F.max(F.when(F.col("begins") == 1, F.col("nth"))).over(label)
    return numbered.select(*spans.columns, F.when(F.col("unresolved"), F.format_string("unknown_%02d", number)).alias("review_id"))


def unknowns(spans: DataFrame) -> DataFrame:
    """(recording_id, review_id, raw_ocr, first_span): the unmatched labels."""
    found = with_review_ids(spans).filter("unresolved")
    return found.groupBy("recording_id", "review_id").agg(F.min_by("raw_ocr", "span_no").alias("raw_ocr"), F.min("span_no").alias("first_span"))


def reconcile(spans: DataFrame, mapping: DataFrame, *, bail: bool = False) -> DataFrame:
    """Names from ``mapping`` (recording_id, review_id, answer) for spans with review ids.

    With ``bail`` whatever is still unmatched stops being pending, without a name.
    """
    joined = spans.join(mapping.select("recording_id", "review_id", "answer"), ["recording_id", "review_id"], "left")
    named = F.col("answer").isNotNull()
    return joined.select(
        "recording_id", "span_no", "start", "end", F.when(named, F.col("answer")).otherwise(F.col("name")).alias("name"), "raw_ocr", "confidence",
        (F.col("unresolved") & ~named & F.lit(not bail)).alias("unresolved"), "review_id",
    )


def frame_for_review(spans: DataFrame, frames: DataFrame, fps: float = 2.0) -> DataFrame:
    """(recording_id, review_id, raw_ocr, frame_index): the frame nearest to the first span of a label (the earliest of equals).

    Frames are numbered from one. The nearest one to a time is its whole neighbour on either side, so
    the join is on frame numbers, not on all frames of a recording.
    """
    first = spans.filter("review_id is not null").groupBy("recording_id", "review_id").agg(F.min_by(F.struct("start", "raw_ocr"), "span_no").alias("s")).select("recording_id", "review_id", "s.*")
    known = frames.select("recording_id", "frame_index").distinct()
    w = Window.partitionBy("recording_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("recording_id").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = ((F.col("frame_index") - 1) / F.lit(float(fps))).alias("at")
    both = known.select("recording_id", at, F.lit(0).alias("kind"), "frame_index", F.lit(None).cast("string").alias("review_id"), F.lit(None).cast("string").alias("raw_ocr")).unionByName(
        first.select("recording_id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("frame_index"), "review_id", "raw_ocr")
    )
    near = both.withColumns({"low": F.last("frame_index", True).over(w), "high": F.last("frame_index", True).over(ahead)}).filter("kind = 1")
    away = lambda c: F.abs((F.col(c) - 1) / F.lit(float(fps)) - F.col("at"))
    pick = F.when(F.col("low").isNull(), F.col("high")).when(F.col("high").isNull() | (away("low") <= away("high")), F.col("low")).otherwise(F.col("high"))
    return near.select("recording_id", "review_id", "raw_ocr", pick.alias("frame_index"))


def review_manifest(spans: DataFrame, frames: DataFrame, fps: float = 2.0) -> DataFrame:
    """What a reviewer needs: label, id and frame."""
    return frame_for_review(with_review_ids(spans), frames, fps)
