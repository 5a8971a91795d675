"""Transcripts: rendering, merging of channels, output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clock(t: Column) -> Column:
    """h:mm:ss of whole seconds."""
    t = F.floor(t).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(t / 3600).cast("long"), F.floor(t % 3600 / 60).cast("long"), t % 60)


def short_clock(t: Column) -> Column:
    """m:ss of whole seconds."""
    t = F.floor(t).cast("long")
    return F.format_string("%d:%02d", F.floor(t / 60).cast("long"), t % 60)


def rendered_line(t: Column, label: Column, text: Column) -> Column:
    return F.concat(F.lit("["), clock(t), F.lit("] ["), label, F.lit("] "), text)


def render(lines: DataFrame) -> DataFrame:
    """(recording_id, text): the lines of a recording in order, each with its line break."""
    line = F.struct("line_no", F.concat(rendered_line(F.col("t"), F.col("label"), F.col("text")), F.lit("\n")).alias("line"))
    grouped = lines.groupBy("recording_id").agg(F.array_sort(F.collect_list(line)).alias("all"))
    return grouped.select("recording_id", F.array_join(F.transform("all", lambda x: x["line"]), "").alias("text"))


def merge_channels(segments: DataFrame) -> DataFrame:
    """SRT segments of both channels by start time (ties: left first, then block), as numbered lines."""
    from pyspark.sql import Window

    side = F.when(F.col("channel") == "left", 0).otherwise(1)
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy("t", side, "block_no")).cast("long")
    return segments.select("recording_id", nth.alias("line_no"), F.floor("t").cast("long").alias("t"), "label", "text")


def channel_of(label: Column, self_label: str = "You") -> Column:
    """The channel of a label: left is oneself, right is everyone else."""
    return F.when(label == self_label, "left").otherwise("right")


def prosody_path(path: Column, label: Column) -> Column:
    """<stem>-<label>-prosody<suffix> beside a transcript."""
    return F.concat(F.regexp_replace(path, r"(\.[^./]*)?$", ""), F.lit("-"), F.lower(label), F.lit("-prosody"), F.regexp_extract(path, r"(\.[^./]*)?$", 1))


def faces_path(path: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"(\.[^./]*)?$", ""), F.lit("-faces.txt"))


def stitched_path(path: Column) -> Column:
    return F.concat(F.lit("transcripts/"), F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), F.lit("-stitched.txt"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def batch_summary(work: DataFrame) -> DataFrame:
    """(total, skipped, failed) of a table of inputs with a ``status``."""
    return work.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"))


def in_batch_order(work: DataFrame, *, key: str = "recording_id", descending: bool = False) -> DataFrame:
    """``work`` sorted as a batch goes through it."""
    return work.orderBy(F.col(key).desc() if descending else F.col(key).asc())


def write_texts(texts: DataFrame, path: str) -> None:
    """One folder for each recording; never over the input of the same job."""
    texts.select("recording_id", "text").write.partitionBy("recording_id").mode("errorifexists").text(path)


def write_spans(spans: DataFrame, path: str) -> None:
    """Spans as one JSON line for each recording."""
    row = F.struct("span_no", "start", "end", "name", "raw_ocr", "confidence", "unresolved")
    grouped = spans.groupBy("recording_id").agg(F.array_sort(F.collect_list(row)).alias("spans"))
    grouped.write.mode("errorifexists").json(path)


def read_spans(spark, path: str) -> DataFrame:
    schema = "recording_id string, spans array<struct<span_no:long,start:double,end:double,name:string,raw_ocr:string,confidence:double,unresolved:boolean>>"
    return spark.read.schema(schema).json(path).select("recording_id", F.inline("spans"))
