"""Recording tables derived from the driver's tables, in DataFrame form and as DuckDB SQL.

They let every operator run over whole tables: conversations stand for recordings, events for pitch and
face samples, embeddings for audio samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAMES = ("Alice Moreno", "Bram Okafor", "Chidi Larsen", "Dunja Weiss", "Elif Tanaka", "Farid Novak")
OTHERS = ("Gwen Ibarra", "Hiro Petrov", "A1ice M0reno", "Brarn Okafar", "Chid1 Lars3n", "Ounja Weiss", "Elit Tanaka", "Farld Novak", "You")
LABELS = NAMES + OTHERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", length.alias("len"), (F.floor(length / 40) + 2).cast("int").alias("n")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, frame_index, kind, who): two frames a second, with flicker and gaps."""
    f = _turns(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("j"))
    half, third = F.floor(F.col("n") / 2), F.floor(F.col("n") / 3)
    gap = (F.col("role") == "system") | ((F.col("j") >= half) & (F.col("j") < half + F.col("len") % 9) & (F.col("n") > 6))
    kind = F.when(gap, "gap").when(F.col("len") % 5 == 0, "unknown").otherwise("name")
    who = F.when((F.col("j") == third) & (F.col("len") % 3 == 0) & (F.col("n") > 6), "Flicker").when(F.col("role") == "user", "You").otherwise(F.concat(F.lit("Guest "), (F.col("turn") % 4).cast("string")))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "j")) - 1
    return f.select(F.col("conv_id").alias("recording_id"), nth.cast("long").alias("frame_index"), kind.alias("kind"), F.when(~gap, who).alias("who"))


OBSERVATIONS_SQL = """
turns AS (SELECT conv_id, turn, role, text, length(text) AS len, CAST(floor(length(text) / 40) + 2 AS INTEGER) AS n FROM conversations),
frames AS (SELECT *, unnest(range(0, n)) AS j FROM turns),
obs AS (
  SELECT recording_id, frame_index, kind, CASE WHEN kind <> 'gap' THEN who END AS who FROM (
    SELECT conv_id AS recording_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, j) - 1 AS frame_index,
      CASE WHEN role = 'system' OR (j >= floor(n / 2) AND j < floor(n / 2) + len % 9 AND n > 6) THEN 'gap'
           WHEN len % 5 = 0 THEN 'unknown' ELSE 'name' END AS kind,
      CASE WHEN j = floor(n / 3) AND len % 3 = 0 AND n > 6 THEN 'Flicker' WHEN role = 'user' THEN 'You'
           ELSE concat('Guest ', CAST(turn % 4 AS VARCHAR)) END AS who
    FROM frames)
)"""


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, line_no, t, label, text)."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    label = F.when(F.col("role") == "user", "You").when(F.col("role") == "assistant", "Caller").otherwise("Note")
    text = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return _turns(spark, sf_dir).select(
        F.col("conv_id").alias("recording_id"), F.col("turn").alias("line_no"), (F.floor(start / 2.0) + 2).cast("long").alias("t"), label.alias("label"), text.alias("text")
    )


TRANSCRIPT_SQL = """
lines AS (
  SELECT conv_id AS recording_id, turn AS line_no, CAST(floor(s0 / 2.0) AS BIGINT) + 2 AS t,
    CASE role WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'Caller' ELSE 'Note' END AS label,
    replace(text, chr(10), ' ') AS text
  FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM turns)
)"""


def transcript_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, value): a transcript file for each recording, with a line that is none."""
    from ..operators.transcript import rendered_line

    line = F.struct("line_no", rendered_line(F.col("t"), F.col("label"), F.col("text")).alias("line"))
    rows = transcript(spark, sf_dir).groupBy("recording_id").agg(F.array_sort(F.collect_list(line)).alias("all"))
    return rows.select("recording_id", F.concat(F.lit("recorded today\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))


def srt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, channel, value): an SRT file for each channel; every tenth turn lacks its text."""
    from ..operators.transcript import clock

    rows = transcript(spark, sf_dir).join(
        _turns(spark, sf_dir).select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("line_no"), "len"), ["recording_id", "line_no"]
    ).filter("label <> 'Note'")
    ms = F.format_string(",%03d", F.col("len") * 37 % 1000)
    stamp = F.concat(F.lpad(F.regexp_extract(clock(F.col("t")), r"^(\d+):", 1), 2, "0"), F.regexp_extract(clock(F.col("t")), r"^\d+(:.*)$", 1), ms)
    block = F.concat(F.col("line_no").cast("string"), F.lit("\n"), stamp, F.lit(" --> 99:00:00,000"), F.when(F.col("line_no") % 10 == 9, "").otherwise(F.concat(F.lit("\n"), F.col("text"))), F.lit("\n\n"))
    channel = F.when(F.col("label") == "You", "left").otherwise("right")
    grouped = rows.groupBy("recording_id", channel.alias("channel")).agg(F.array_sort(F.collect_list(F.struct("line_no", block.alias("b")))).alias("all"))
    return grouped.select("recording_id", "channel", F.array_join(F.transform("all", lambda x: x["b"]), "").alias("value"))


SRT_SQL = """
blocks AS (
  SELECT l.recording_id, l.line_no, l.t + ((t.len * 37) % 1000) / 1000.0 AS t, l.label, trim(l.text) AS text,
    CASE l.label WHEN 'You' THEN 'left' ELSE 'right' END AS channel,
    row_number() OVER (PARTITION BY l.recording_id, l.label ORDER BY l.line_no) - 1 AS block_no
  FROM lines l JOIN turns t ON t.conv_id = l.recording_id AND t.turn = l.line_no WHERE l.label <> 'Note'
),
segments AS (SELECT * FROM blocks WHERE line_no % 10 <> 9 AND text <> '')"""


def pitch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, utt, t, f0, intensity, duration, words): twelve frames an utterance."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), nth.alias("rn"), "event_type", "value")
    rows = rows.withColumn("utt", F.floor(F.col("rn") / 12).cast("long"))
    return rows.select(
        "recording_id", "utt", (F.col("rn") * F.lit(0.1)).alias("t"), F.when(F.col("event_type") != "error", F.col("value") + 75).alias("f0"), (F.col("value") / 10 + 40).alias("intensity"),
        (F.col("utt") % 3 + 1).cast("double").alias("duration"), (F.col("utt") * 7 % 11).cast("long").alias("words"),
    )


PITCH_SQL = """
frames AS (
  SELECT recording_id, utt, rn * 0.1::DOUBLE AS t, CASE WHEN event_type <> 'error' THEN value + 75 END AS f0, value / 10 + 40 AS intensity,
    (utt % 3 + 1)::DOUBLE AS duration, (utt * 7) % 11 AS words
  FROM (SELECT user_id AS recording_id, event_type, value, rn, rn // 12 AS utt FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events))
)"""


def voiced_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, t): hours of events, standing for voiced frames."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t"), "event_id")


def face_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, t, smile, pitch_deg): two samples a second."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"), (nth * F.lit(0.5)).alias("t"), F.when(F.col("event_type") != "error", F.col("value") / 500).alias("smile"), F.when(F.col("event_type") != "signup", F.col("value") / 10).alias("pitch_deg")
    )


FACES_SQL = """
samples AS (
  SELECT user_id AS recording_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 0.5::DOUBLE AS t,
    CASE WHEN event_type <> 'error' THEN value / 500 END AS smile, CASE WHEN event_type <> 'signup' THEN value / 10 END AS pitch_deg
  FROM events
)"""


def audio_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, channel, t, x): each label's vectors as sound, quieter by label."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("recording_id"), (F.col("vec_id") % 2).alias("channel"), "vec_id", F.posexplode("embedding").alias("i", "v"))
    return rows.select("recording_id", "channel", (F.col("vec_id") / 2.0 + F.col("i") / 128.0).alias("t"), (F.col("v").cast("double") * F.pow(F.lit(10.0), -F.col("recording_id") * F.lit(0.5))).alias("x"))


AUDIO_SQL = """
samples AS (
  SELECT label::BIGINT AS recording_id, vec_id % 2 AS channel, vec_id / 2.0::DOUBLE + i / 128.0::DOUBLE AS t, embedding[i + 1]::DOUBLE * pow(10.0, -label * 0.5) AS x
  FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings)
)"""


def _label(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), (index + 1).cast("int"))


CAPTION_WIDTH = 60


def caption_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, frame_index, line_no, line): a speaker label above the whole turn, in caption lines of a fixed width."""
    said = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("frame_index"), _label((F.col("conv_id") + F.col("turn")) % 15).alias("label"), said.alias("said"))
    begins = F.sequence(F.lit(1), F.greatest(F.length("said"), F.lit(1)), F.lit(CAPTION_WIDTH))
    lines = F.transform(begins, lambda i: F.substring("said", i, F.lit(CAPTION_WIDTH)))
    return rows.select("recording_id", "frame_index", F.posexplode(F.concat(F.array("label"), lines)).alias("line_no", "line"))


_LIST = ", ".join(f"'{n}'" for n in LABELS)
CAPTIONS_SQL = f"""
captions AS (
  SELECT recording_id, frame_index, line_no, line FROM (
    SELECT conv_id AS recording_id, turn AS frame_index, 0 AS line_no, ([{_LIST}])[((conv_id + turn) % 15 + 1)::INTEGER] AS line FROM conversations
    UNION ALL SELECT conv_id, turn, k + 1, substr(said, k * {CAPTION_WIDTH} + 1, {CAPTION_WIDTH})
      FROM (SELECT conv_id, turn, said, unnest(range(0, greatest(1, ceil(length(said) / {CAPTION_WIDTH})::BIGINT))) AS k FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS said FROM conversations)))
)"""


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR words of the caption frames; confidence varies from 60 to 99."""
    lines = caption_frames(spark, sf_dir)
    words = lines.select(F.col("recording_id"), F.col("frame_index").alias("frame_no"), "line_no", F.length("line").alias("len"), F.posexplode(F.filter(F.split("line", " "), lambda w: w != "")).alias("word_no", "word"))
    return words.select(
        "recording_id", "frame_no", (F.col("line_no") * 1000 + F.col("word_no")).alias("row_no"), F.lit("1").alias("block"), F.lit("1").alias("par"), F.col("line_no").cast("string").alias("line"),
        (F.col("word_no") * 10).alias("left"), (F.col("line_no") * 20 + F.col("word_no") % 3).alias("top"), (F.col("len") * 13 + F.col("word_no")).cast("int").__mod__(40).__add__(60).cast("double").alias("conf"), "word",
    )


OCR_SQL = """
ocr AS (
  SELECT recording_id, frame_no, line_no, word_no, word, line_no * 1000 + word_no AS row_no, word_no * 10 AS "left", line_no * 20 + word_no % 3 AS top, (len * 13 + word_no) % 40 + 60 AS conf
  FROM (SELECT recording_id, frame_no, line_no, len, w[i + 1] AS word, i AS word_no FROM (
    SELECT *, unnest(range(0, len(w))) AS i FROM (
      SELECT recording_id, frame_index AS frame_no, line_no, length(line) AS len, list_filter(string_split(line, ' '), lambda x: x <> '') AS w FROM captions)))
)"""


def roster_candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, n) for i, n in enumerate(NAMES)], "member_ord int, canonical string, candidate string")


def caption_windows(spark: SparkSession, sf_dir: str, width: int = 20, step: int = 5) -> DataFrame:
    """(recording_id, frame_no, tokens): windows that slide over a conversation's tokens."""
    words = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w: F.struct(F.lit(False).alias("is_spk"), w.alias("tok")))
    mark = F.array(F.struct(F.lit(True).alias("is_spk"), F.col("role").alias("tok")))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording_id"), "turn", F.concat(mark, words).alias("t"))
    whole = rows.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t"))).alias("all")).select("recording_id", F.flatten(F.transform("all", lambda x: x["t"])).alias("tokens"))
    last = F.greatest(F.lit(0), F.ceil((F.size("tokens") - width) / step)).cast("int")
    return whole.select("recording_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("frame_no")).select("recording_id", "frame_no", F.slice("tokens", F.col("frame_no") * step + 1, width).alias("tokens"))


def revised_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows as a recogniser shows them: the last word is still half of itself, and in every fifth frame a word is misread."""
    half = lambda t: F.substring(t, F.lit(1), F.ceil(F.length(t) / 2).cast("int"))
    misread = (F.col("frame_no") % 5 == 3) & (F.size("tokens") > 9)

    def shown(t, i):
        tok = F.when(misread & (i == 8), F.lit("xx")).when(i == F.size("tokens") - 1, half(t["tok"])).otherwise(t["tok"])
        return F.when(t["is_spk"], t).otherwise(F.struct(t["is_spk"].alias("is_spk"), tok.alias("tok")))

    return caption_windows(spark, sf_dir).select("recording_id", "frame_no", F.transform("tokens", shown).alias("tokens"))
