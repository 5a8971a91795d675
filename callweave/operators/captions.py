"""On-screen captions: filters of OCR text, line assembly, the active speaker of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that decide which lines are captions.
CONFIDENCE = 70
CHROME = ("Summarize captions", "Summarize Captions")
JUNK = (
    "elgato|wave link|system default|speaker device|microphonefx|stream recording|test speakers?"
    r"|\bdevice\b|\bplayin|meet\.google|live captions|english captions|jump to bottom"
)


def name_like(line: Column) -> Column:
    """One to four words, no closing punctuation, no brackets, a capital at some word's begin."""
    line = F.trim(line)
    words = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != ""))
    return words.between(1, 4) & ~line.rlike(r"[.?!,:;]$") & ~line.rlike(r"[(){}\[\]=<>/]") & line.rlike(r"(^|\s)\p{Lu}")


def clean_lines(texts: DataFrame, value: str = "value") -> DataFrame:
    """(keys, line_no, line): non-empty lines from their first capital on, without interface labels."""
    keys = [c for c in texts.columns if c != value]
    lines = texts.select(*keys, F.posexplode(F.split(value, r"\r\n|\n")).alias("line_no", "raw")).withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", "")).filter("raw <> ''")
    upper = F.regexp_extract("raw", r"[A-Z].*$", 0)
    return lines.select(*keys, "line_no", F.when(upper != "", upper).otherwise(F.col("raw")).alias("line")).filter(~F.col("line").isin(*CHROME))


def junk(line: Column) -> Column:
    return line.rlike(f"(?i){JUNK}")


def gibberish(line: Column) -> Column:
    """Three words or more of which over three in ten look misread.

    Words are counted by what regular expressions leave of a line whose words are their letters alone, so that no
    list of words is built.
    """
    letters = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(line, r"[^A-Za-z\s]", ""), r"\s+", "  "), F.lit(" "))
    words = F.regexp_count(letters, F.lit("[A-Za-z]+"))
    odd = F.regexp_count(letters, F.lit(" (?:[A-Za-z]*[a-z][A-Z][A-Za-z]*|[A-Z]{4,}|[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]{4,})(?= )"))
    return (words >= 3) & (odd / words > 0.3)


def caption_lines(words: DataFrame, confidence: int = CONFIDENCE) -> DataFrame:
    """(recording_id, frame_no, line_no, top, text): OCR words put together, lines from top to bottom.

    ``words``: recording_id, frame_no, row_no, block, par, line, left, top, conf, word.
    """
    good = words.filter((F.trim("word") != "") & (F.col("conf") >= confidence))
    place = F.struct("left", "row_no", F.trim("word").alias("word"))
    lines = good.groupBy("recording_id", "frame_no", "block", "par", "line").agg(F.array_sort(F.collect_list(place)).alias("w"), F.sort_array(F.collect_list("top")).alias("tops"), F.min("row_no").alias("first"))
    built = lines.select(
        "recording_id", "frame_no", "first", F.element_at("tops", (F.floor(F.size("tops") / 2) + 1).cast("int")).alias("top"), F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text")
    )
    kept = built.filter((F.length(F.regexp_replace("text", "[^a-zA-Z]", "")) >= 2) & ~junk(F.col("text")) & ~gibberish(F.col("text")))
    listed = kept.groupBy("recording_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("top", "first", "text"))).alias("all"))
    return listed.select("recording_id", "frame_no", F.posexplode("all").alias("line_no", "l")).select("recording_id", "frame_no", "line_no", "l.top", "l.text")


def bottom_label(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, raw): the lowest name-like line of a frame; frames without one are gaps and left out."""
    named = lines.withColumn("raw", F.trim("line")).filter(name_like(F.col("raw")))
    return named.groupBy(*keys).agg(F.max_by("raw", "line_no").alias("raw"))


def observations(frames: DataFrame, labels: DataFrame, matches: DataFrame) -> DataFrame:
    """(recording_id, frame_index, kind, who) of all frames: ``frames`` have band_present, ``labels`` raw, ``matches`` (raw, name)."""
    from .timeline import observation_key

    joined = frames.join(labels, ["recording_id", "frame_index"], "left").join(matches.select("raw", "name"), "raw", "left")
    seen = F.col("band_present")
    kind, who = observation_key(F.when(seen, F.col("name")), F.when(seen, F.col("raw")))
    return joined.select("recording_id", "frame_index", kind.alias("kind"), who.alias("who"))


def band_present(pixels: DataFrame, *, dark: int = 90, fraction: float = 0.35) -> DataFrame:
    """(recording_id, frame_index, band_present): whether enough pixels of a band are dark."""
    share = F.avg((F.col("gray") < dark).cast("double"))
    return pixels.groupBy("recording_id", "frame_index").agg((share >= F.lit(fraction)).alias("band_present"))


def crop(pixels: DataFrame, region: tuple[int, int, int, int]) -> DataFrame:
    x, y, w, h = region
    return pixels.filter(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
