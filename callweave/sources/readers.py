"""Sources: rosters, transcripts, SRT, OCR tables, frame listings. Text is parsed by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROSTER = "self string, members array<struct<canonical:string, aliases:array<string>>>"
LINE = r"^\[(\d+):(\d+):(\d+)\] \[([^\]]+)\] (.*)$"
SRT_CLOCK = r"(\d+):(\d+):(\d+),(\d+)\s-->"
OCR_TSV = "level string, page string, block string, par string, line string, word_num string, left string, top string, width string, height string, conf string, text string"


def roster(spark: SparkSession, path: str) -> DataFrame:
    """One row for each roster file: self, members (an absent list is empty)."""
    raw = spark.read.schema(ROSTER).option("multiLine", True).json(path)
    return raw.withColumn("members", F.coalesce("members", F.array().cast("array<struct<canonical:string,aliases:array<string>>>")))


def roster_candidates(rosters: DataFrame) -> DataFrame:
    """(member_ord, canonical, candidate): a canonical name first, then its aliases."""
    members = rosters.select(F.posexplode("members").alias("member_ord", "m"))
    names = F.concat(F.array("m.canonical"), F.coalesce("m.aliases", F.array().cast("array<string>")))
    return members.select("member_ord", F.col("m.canonical").alias("canonical"), F.explode(names).alias("candidate"))


def file_name() -> Column:
    """Plain name of the file that a row was read from; Spark gives it as part of a URI."""
    return F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, value): one row for each file, named by its stem."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(stem(file_name()).alias("recording_id"), "value")


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, name) of files, their contents not read; ``recording_id`` as ``whole_texts`` names them."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(stem(file_name()).alias("recording_id"), file_name().alias("name"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def parse_transcript(texts: DataFrame, value: str = "value") -> DataFrame:
    """(recording_id, line_no, t, label, text) of ``[h:mm:ss] [Label] text`` lines; other lines are left out."""
    lines = texts.select("recording_id", F.posexplode(F.split(value, "\r?\n")).alias("line_no", "line")).filter(F.col("line").rlike(LINE))
    part = lambda i: F.regexp_extract("line", LINE, i)
    clock = part(1).cast("long") * 3600 + part(2).cast("long") * 60 + part(3).cast("long")
    return lines.select("recording_id", "line_no", clock.alias("t"), part(4).alias("label"), part(5).alias("text"))


def rejected_lines(texts: DataFrame, value: str = "value") -> DataFrame:
    """The non-empty lines that ``parse_transcript`` leaves out."""
    lines = texts.select("recording_id", F.posexplode(F.split(value, "\r?\n")).alias("line_no", "line"))
    return lines.filter((F.trim("line") != "") & ~F.col("line").rlike(LINE))


def parse_srt(texts: DataFrame, value: str = "value") -> DataFrame:
    """(recording_id, channel, block_no, t, text): blocks of a clock line and some text."""
    blocks = texts.select("recording_id", "channel", F.posexplode(F.split(F.trim(F.col(value)), "\n\n")).alias("block_no", "block"))
    lines = F.split(F.regexp_replace(F.col("block"), r"^\s+|\s+$", ""), "\n")
    rows = blocks.withColumn("lines", lines).filter((F.size("lines") >= 3) & F.col("lines")[1].rlike(SRT_CLOCK))
    part = lambda i: F.regexp_extract(F.col("lines")[1], SRT_CLOCK, i).cast("double")
    text = F.trim(F.array_join(F.slice("lines", 3, F.size("lines")), " "))
    rows = rows.select("recording_id", "channel", "block_no", (part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000.0).alias("t"), text.alias("text"))
    return rows.filter(F.col("text") != "")


def ocr_table(spark: SparkSession, path: str) -> DataFrame:
    """OCR words of TSV files, a file for each frame; rows with unreadable numbers are left out."""
    raw = spark.read.schema(OCR_TSV).csv(path, sep="\t", header=True, quote="", mode="PERMISSIVE")
    file = F.col("_metadata.file_path")
    rows = raw.select(
        F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("recording_id"), F.regexp_extract(file, r"_(\d+)\.[^./]*$", 1).cast("int").alias("frame_no"),
        "block", "par", "line", F.expr("try_cast(left as int)").alias("left"), F.expr("try_cast(top as int)").alias("top"),
        F.expr("try_cast(conf as double)").alias("conf"), F.trim("text").alias("word"), F.expr("try_cast(word_num as int)").alias("row_no"),
    )
    return rows.filter("left is not null and top is not null and conf is not null")


def binary_frames(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(recording_id, frame_index, content) of numbered image files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("recording_id"), F.regexp_extract("path", r"_(\d+)\.", 1).cast("long").alias("frame_index"), "content")


def file_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(recording_id, size) of files in bytes; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(stem(F.col("path")).alias("recording_id"), F.col("length").alias("size"))


def recordings(spark: SparkSession, root: str, folder: str = "audio_only", pattern: str = "*.mp3") -> DataFrame:
    """(recording_id, path) of files that stand in a folder of the given name, at any depth below the root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.filter(F.col("path").contains(f"/{folder}/")).select(stem(F.col("path")).alias("recording_id"), "path")


def frame_time(frame_index: Column, fps: float) -> Column:
    """Seconds of a frame numbered from one."""
    return (frame_index - 1).cast("double") / F.lit(float(fps))


def not_yet_done(inputs: DataFrame, outputs: DataFrame, key: str = "recording_id") -> DataFrame:
    """Inputs without an output."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def under_root(paths: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Paths inside a folder; both are taken without trailing slashes."""
    return paths.filter(F.col(path).startswith(root.rstrip("/") + "/"))


def both_channels(segments: DataFrame, wanted: int = 2) -> DataFrame:
    """Recordings that have segments of all channels."""
    return segments.groupBy("recording_id").agg(F.countDistinct("channel").alias("channels")).filter(F.col("channels") == wanted)


def wav_samples(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, channel, rate, samples) of 16-bit WAV files; channels are taken apart in the tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path).select(stem(F.col("path")).alias("recording_id"), "content")

    def run(batches):
        import io
        import wave

        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["recording_id"], batch["content"], strict=True):
                with wave.open(io.BytesIO(content)) as f:
                    n, rate = f.getnchannels(), f.getframerate()
                    data = np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, n) / 32768.0
                for c in range(n):
                    yield pd.DataFrame({"recording_id": [name], "channel": [c], "rate": [rate], "samples": [data[:, c]]})

    return files.mapInPandas(run, "recording_id string, channel int, rate int, samples array<double>")


def progress_marks(log: DataFrame, duration: float, line: str = "line") -> DataFrame:
    """Percent done of a transcription log ``[... --> h:mm:ss.mmm]``, one row for each change."""
    from pyspark.sql import Window

    pattern = r"-->\s*(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)\]"
    part = lambda i: F.coalesce(F.regexp_extract(line, pattern, i).try_cast("double"), F.lit(0.0))
    seen = log.filter(F.col(line).rlike(pattern)).withColumn("seconds", part(1) * 3600 + part(2) * 60 + part(3))
    seen = seen.withColumn("percent", F.floor(F.least(F.col("seconds") / F.lit(float(duration)), F.lit(1.0)) * 100).cast("int"))
    w = Window.partitionBy("recording_id").orderBy("line_no")
    return seen.withColumn("before", F.lag("percent").over(w)).filter("before is null or before <> percent").drop("before")
