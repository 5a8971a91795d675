"""Queries of delivery: utterances, prosody, faces, channel levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import faces as fc
from ..operators import levels as lv
from ..operators import prosody as pr
from ..sources import fixtures as fx
from .speakers import _LINES

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


KEYS = ["recording_id", "utt"]
_WINDOWS = f"""{_LINES}, following AS (SELECT *, least(t + 15.0::DOUBLE, (lead(t) OVER (PARTITION BY recording_id ORDER BY line_no))::DOUBLE) AS t_end FROM lines),
utterances AS (SELECT recording_id, line_no, t::DOUBLE AS t_start, t_end, label, text FROM following WHERE t_end - t >= 0.6)"""
_FRAMES = f"WITH {fx.PITCH_SQL}"
_FEATURES = (
    _FRAMES
    + """,
lists AS (SELECT recording_id, utt, max(duration) AS duration, max(words) AS words, list_sort(list(f0) FILTER (f0 IS NOT NULL)) AS f, count(f0) AS voiced, count(*) AS total, median(f0) AS mid FROM frames GROUP BY ALL),
pitch AS (SELECT *, CASE WHEN voiced >= 8 THEN mid END AS f0_med,
  CASE WHEN voiced >= 8 THEN f[least(voiced - 1, floor(voiced * 0.9))::INTEGER + 1] - f[greatest(0, floor(voiced * 0.1) - 1)::INTEGER + 1] END AS f0_range, voiced / greatest(1, total) AS voiced_frac FROM lists),
tails AS (SELECT *, row_number() OVER (PARTITION BY recording_id, utt ORDER BY t) - 1 AS nth, count(*) OVER (PARTITION BY recording_id, utt) AS n FROM frames WHERE f0 IS NOT NULL),
slopes AS (SELECT recording_id, utt, CASE WHEN count(*) >= 3 THEN coalesce(regr_slope(f0, t), 0.0) END AS f0_slope FROM tails WHERE n >= 8 AND nth >= floor(n * 0.6) GROUP BY ALL),
ranges AS (SELECT *, min(t) FILTER (f0 IS NOT NULL) OVER (PARTITION BY recording_id, utt) AS lo, max(t) FILTER (f0 IS NOT NULL) OVER (PARTITION BY recording_id, utt) AS hi FROM frames),
energies AS (SELECT recording_id, utt, avg(intensity) FILTER ((lo IS NULL OR t BETWEEN lo AND hi) AND intensity <> 0) AS energy FROM ranges GROUP BY ALL),
features AS (SELECT p.recording_id, p.utt, p.duration, f0_med, f0_range, f0_slope, energy, CASE WHEN words > 0 THEN words / p.duration END AS rate
  FROM pitch p LEFT JOIN slopes s USING (recording_id, utt) LEFT JOIN energies e USING (recording_id, utt))"""
)


def _z(name: str) -> str:
    p = "OVER (PARTITION BY recording_id)"
    own = "FILTER (duration >= 1.5)"
    few = f"count({name}) {own} {p} < 3"
    mean = f"CASE WHEN {few} THEN avg({name}) {p} ELSE avg({name}) {own} {p} END"
    sd = f"CASE WHEN {few} THEN stddev_pop({name}) {p} ELSE stddev_pop({name}) {own} {p} END"
    return f"CASE WHEN count({name}) {p} >= 3 AND ({sd}) > 1e-9 THEN ({name} - ({mean})) / ({sd}) END AS z_{name}"


_SCORES = _FEATURES + ", scores AS (SELECT *, " + ", ".join(map(_z, pr.FEATURES)) + " FROM features)"
_BIG = "greatest(" + ", ".join(f"abs(z_{n})" for n in pr.FEATURES) + ")"


def _bit(name: str, label: str, least: float) -> str:
    return f"CASE WHEN abs(z_{name}) >= {least} THEN '{label} ' || printf('%+.1f', z_{name}) || 'σ' END"


_TAGS = (
    _SCORES
    + f""", bits AS (SELECT *, concat_ws(' · ', {_bit("f0_med", "pitch", 0.5)}, CASE WHEN abs(f0_slope) >= 20 THEN CASE WHEN f0_slope > 0 THEN 'rising' ELSE 'falling' END END,
  {_bit("f0_range", "animation", 0.75)}, {_bit("energy", "energy", 0.75)}, {_bit("rate", "pace", 1.0)}) AS b FROM scores),
tags AS (SELECT *, CASE WHEN b = '' THEN '' ELSE '{{' || b || '}}' END AS tag FROM bits)"""
)


@query(f"{_WINDOWS} SELECT * FROM utterances")
def utterance_windows(spark, sf_dir):
    return pr.utterance_windows(fx.transcript(spark, sf_dir))


@query(f"""{_WINDOWS} SELECT recording_id, line_no, round(CASE WHEN n > 0 THEN n / (t_end - t_start) END, 4) AS rate
FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM utterances)""")
def utterance_rate(spark, sf_dir):
    from ..operators.transcript import word_count

    rows = pr.utterance_windows(fx.transcript(spark, sf_dir))
    return rows.select("recording_id", "line_no", F.round(pr.rate(word_count(F.col("text")), F.col("t_end") - F.col("t_start")), 4).alias("rate"))


@query(f"{_FEATURES} SELECT recording_id, utt, round(f0_med, 4) AS f0_med, round(f0_range, 4) AS f0_range FROM pitch")
def pitch_features(spark, sf_dir):
    return pr.pitch_features(fx.pitch_frames(spark, sf_dir), KEYS).select(*KEYS, F.round("f0_med", 4).alias("f0_med"), F.round("f0_range", 4).alias("f0_range"))


@query(f"{_FEATURES} SELECT recording_id, utt, round(voiced_frac, 4) AS voiced_frac FROM pitch")
def voiced_fraction(spark, sf_dir):
    return pr.pitch_features(fx.pitch_frames(spark, sf_dir), KEYS).select(*KEYS, F.round("voiced_frac", 4).alias("voiced_frac"))


@query(f"{_FEATURES} SELECT recording_id, utt, round(f0_slope, 4) AS f0_slope FROM slopes")
def terminal_slope(spark, sf_dir):
    return pr.terminal_slope(fx.pitch_frames(spark, sf_dir), KEYS).select(*KEYS, F.round("f0_slope", 4).alias("f0_slope"))


@query(f"{_FEATURES} SELECT recording_id, utt, round(energy, 7) AS energy FROM energies")
def voiced_energy(spark, sf_dir):
    return pr.voiced_energy(fx.pitch_frames(spark, sf_dir), KEYS).select(*KEYS, F.round("energy", 7).alias("energy"))


@query(f"{_FRAMES}, utts AS (SELECT recording_id, utt, min(t) + 0.25 AS a, max(t) - 0.25 AS b FROM frames GROUP BY ALL) SELECT u.recording_id, u.utt, count(*) AS frames FROM utts u JOIN frames f ON f.recording_id = u.recording_id AND f.t BETWEEN u.a AND u.b GROUP BY ALL")
def utterance_slices(spark, sf_dir):
    frames = fx.pitch_frames(spark, sf_dir)
    utts = frames.groupBy(*KEYS).agg((F.min("t") + F.lit(0.25)).alias("t_start"), (F.max("t") - F.lit(0.25)).alias("t_end"))
    return pr.frames_of(utts, frames.select("recording_id", "t", "f0")).groupBy(*KEYS).agg(F.count("*").alias("frames"))


def _features(spark, sf_dir):
    out = pr.utterance_features(fx.pitch_frames(spark, sf_dir), KEYS, (F.max("duration").alias("duration"), F.max("words").alias("words")))
    return out.withColumn("rate", pr.rate(F.col("words"), F.col("duration")))


def _scores(spark, sf_dir):
    return pr.zscores(_features(spark, sf_dir), ["recording_id"])


@query(f"{_SCORES} SELECT recording_id, utt, " + ", ".join(f"round(z_{n}, 4) AS z_{n}" for n in pr.FEATURES) + " FROM scores")
def prosody_zscores(spark, sf_dir):
    return _scores(spark, sf_dir).select(*KEYS, *(F.round(f"z_{n}", 4).alias(f"z_{n}") for n in pr.FEATURES))


def _tagged(spark, sf_dir):
    rows = _scores(spark, sf_dir)
    return rows.withColumn("tag", pr.tag({n: F.col(f"z_{n}") for n in pr.FEATURES}, F.col("f0_slope")))


@query(f"{_TAGS} SELECT recording_id, utt, tag FROM tags")
def prosody_tags(spark, sf_dir):
    return _tagged(spark, sf_dir).select(*KEYS, "tag")


@query(f"""{_SCORES} SELECT recording_id, utt, round(deviation, 4) AS deviation, place FROM (SELECT *, {_BIG} AS deviation,
  row_number() OVER (PARTITION BY recording_id ORDER BY {_BIG} DESC, utt) AS place FROM scores WHERE {_BIG} IS NOT NULL AND duration >= 2.0) WHERE place <= 10""")
def top_deviations(spark, sf_dir):
    return pr.top_deviations(_scores(spark, sf_dir), ["recording_id"], "utt").select(*KEYS, F.round("deviation", 4).alias("deviation"), F.col("place").cast("long").alias("place"))


@query(f"""{_TAGS}, turns AS (SELECT conv_id, turn, role, text, length(text) AS len, CAST(floor(length(text) / 40) + 2 AS INTEGER) AS n FROM conversations), {fx.TRANSCRIPT_SQL},
marks AS (SELECT recording_id, t, arg_max(tag, utt) AS tag FROM (SELECT recording_id, round_even(utt * 1.5, 0)::BIGINT AS t, utt, tag FROM tags) GROUP BY ALL)
SELECT l.recording_id, l.line_no, l.t, coalesce(m.tag, '') AS tag FROM lines l LEFT JOIN marks m ON m.recording_id = l.recording_id AND m.t = l.t""")
def annotate_lines(spark, sf_dir):
    tagged = _tagged(spark, sf_dir).select("recording_id", (F.col("utt") * 1.5).alias("t_start"), F.col("utt").alias("line_no"), "tag")
    return pr.annotate(fx.transcript(spark, sf_dir), tagged).select("recording_id", "line_no", "t", "tag")


@query("""WITH RECURSIVE base AS (SELECT user_id AS recording_id, epoch_us(ts) / 3.6e9 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT recording_id, n, t AS start, t AS prev, NULL::DOUBLE AS a, NULL::DOUBLE AS b FROM base WHERE n = 1
  UNION ALL
  SELECT b.recording_id, b.n, CASE WHEN b.t - w.prev > 12 OR b.t - w.start > 48 THEN b.t ELSE w.start END, b.t,
    CASE WHEN (b.t - w.prev > 12 OR b.t - w.start > 48) AND w.prev - w.start >= 1 THEN w.start END,
    CASE WHEN (b.t - w.prev > 12 OR b.t - w.start > 48) AND w.prev - w.start >= 1 THEN w.prev + 0.01 END
  FROM walk w JOIN base b ON b.recording_id = w.recording_id AND b.n = w.n + 1
),
ended AS (SELECT recording_id, a, b FROM walk WHERE a IS NOT NULL
  UNION ALL SELECT recording_id, start, prev + 0.01 FROM (SELECT *, max(n) OVER (PARTITION BY recording_id) AS top FROM walk) WHERE n = top AND prev - start >= 1)
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY a) AS segment_no, round(a, 4) AS t_start, round(b, 4) AS t_end FROM ended""")
def vad_segments(spark, sf_dir):
    found = pr.vad_segments(fx.voiced_times(spark, sf_dir), step=0.01, silence_bridge=12, longest=48, shortest=1, order="event_id")
    return found.select("recording_id", "segment_no", F.round("t_start", 4).alias("t_start"), F.round("t_end", 4).alias("t_end"))


# ---------------------------------------------------------------- faces

_SAMPLES = f"WITH {fx.FACES_SQL}"
_BASE = """base AS (SELECT recording_id, count(smile) AS detected, count(*) AS total, CASE WHEN count(smile) >= 10 THEN avg(smile) ELSE 0.0 END AS smile_mean,
  CASE WHEN count(smile) >= 10 THEN stddev_pop(smile) ELSE 0.0 END AS smile_sd FROM samples GROUP BY recording_id)"""


@query(f"{_SAMPLES}, {_BASE} SELECT recording_id, detected, total, round(smile_mean, 6) AS smile_mean, round(smile_sd, 6) AS smile_sd FROM base")
def smile_baseline(spark, sf_dir):
    found = fc.smile_baseline(fx.face_samples(spark, sf_dir))
    return found.select("recording_id", "detected", "total", F.round("smile_mean", 6).alias("smile_mean"), F.round("smile_sd", 6).alias("smile_sd"))


@query(f"""{_SAMPLES}, bins AS (SELECT recording_id, floor(t / 30)::BIGINT AS bin, count(*) AS n, avg(smile) AS m FROM samples WHERE smile IS NOT NULL GROUP BY ALL HAVING count(*) >= 20)
SELECT recording_id, bin, n, round(m, 4) AS mean_smile, place FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY m DESC, bin DESC) AS place FROM bins) WHERE place <= 10""")
def smile_bins_top10(spark, sf_dir):
    return fc.smile_bins(fx.face_samples(spark, sf_dir)).select("recording_id", "bin", "n", F.round("mean_smile", 4).alias("mean_smile"), "place")


@query(f"""{_SAMPLES}, {_BASE}, near AS (SELECT *, avg(smile) OVER (PARTITION BY recording_id ORDER BY t RANGE BETWEEN 2.0 PRECEDING AND 2.0 FOLLOWING) AS m FROM samples)
SELECT n.recording_id, n.t, round(CASE WHEN smile_sd >= 1e-9 THEN (m - smile_mean) / smile_sd END, 4) AS z FROM near n JOIN base b ON b.recording_id = n.recording_id""")
def smile_z(spark, sf_dir):
    return fc.smile_z(fx.face_samples(spark, sf_dir)).select("recording_id", "t", F.round("z", 4).alias("z"))


_NODS = f"""{_SAMPLES}, centres AS (SELECT recording_id, t AS c FROM samples),
points AS (SELECT c.recording_id, c.c, s.t, s.pitch_deg, s.pitch_deg - lag(s.pitch_deg) OVER (PARTITION BY c.recording_id, c.c ORDER BY s.t) AS d
  FROM centres c JOIN samples s ON s.recording_id = c.recording_id AND abs(s.t - c.c) <= 2.0 WHERE s.pitch_deg IS NOT NULL),
sizes AS (SELECT recording_id, c, count(*) AS n FROM points GROUP BY ALL),
moves AS (SELECT recording_id, c, sign(d) <> lag(sign(d)) OVER (PARTITION BY recording_id, c ORDER BY t) AS turned FROM points WHERE abs(d) >= 1.5),
turns AS (SELECT recording_id, c, count(*) FILTER (turned) AS n FROM moves GROUP BY ALL)"""


@query(f"""{_NODS} SELECT c.recording_id, c.c AS t, coalesce(s.n >= 5 AND m.n >= 3, false) AS nodding FROM centres c
LEFT JOIN sizes s ON s.recording_id = c.recording_id AND s.c = c.c LEFT JOIN turns m ON m.recording_id = c.recording_id AND m.c = c.c""")
def nod_detection(spark, sf_dir):
    return fc.nods(fx.face_samples(spark, sf_dir)).select("recording_id", "t", "nodding")


@query(f"""{_NODS}, {_BASE},
bins AS (SELECT recording_id, floor(t / 30)::BIGINT AS bin, avg(smile) AS m FROM samples WHERE smile IS NOT NULL GROUP BY ALL HAVING count(*) >= 20),
placed AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY m DESC, bin DESC) AS place FROM bins),
rows_ AS (SELECT p.recording_id, place, printf('  [%d:%02d-%d:%02d]  %.3f', bin * 30 // 60, bin * 30 % 60, (bin * 30 + 30) // 60, (bin * 30 + 30) % 60, m)
    || CASE WHEN coalesce(s.n >= 5 AND t.n >= 3, false) THEN ' + nodding' ELSE '' END || chr(10) AS line
  FROM placed p LEFT JOIN sizes s ON s.recording_id = p.recording_id AND s.c = p.bin * 30 + 15 LEFT JOIN turns t ON t.recording_id = p.recording_id AND t.c = p.bin * 30 + 15 WHERE place <= 10),
listed AS (SELECT recording_id, string_agg(line, '' ORDER BY place) AS lines FROM rows_ GROUP BY ALL)
SELECT b.recording_id, printf('facial affect track: %d', b.recording_id) || chr(10) || printf('face detected in %d/%d frames; baseline smile %.3f (sd %.3f)', detected, total, smile_mean, smile_sd)
  || chr(10) || chr(10) || 'warmest 30s windows (mean raw smile vs baseline):' || chr(10) || coalesce(lines, '') AS text
FROM base b LEFT JOIN listed l ON l.recording_id = b.recording_id""")
def face_report(spark, sf_dir):
    return fc.report(fx.face_samples(spark, sf_dir))


# ---------------------------------------------------------------- levels

_LEVELS = f"""WITH {fx.AUDIO_SQL}, levels AS (SELECT recording_id, channel, CASE WHEN p > 0 THEN 10 * log10(p) ELSE '-inf'::DOUBLE END AS mean_db, CASE WHEN m > 0 THEN 10 * log10(m * m) ELSE '-inf'::DOUBLE END AS max_db
  FROM (SELECT recording_id, channel, avg(x * x) AS p, max(abs(x)) AS m FROM samples GROUP BY ALL))"""


@query(f"{_LEVELS} SELECT recording_id, channel, round(mean_db, 3) AS mean_db, round(max_db, 3) AS max_db FROM levels")
def channel_levels(spark, sf_dir):
    return lv.channel_levels(fx.audio_samples(spark, sf_dir)).select("recording_id", "channel", F.round("mean_db", 3).alias("mean_db"), F.round("max_db", 3).alias("max_db"))


@query(f"""WITH {fx.AUDIO_SQL}, durations AS (SELECT recording_id, max(t) AS d FROM samples GROUP BY 1),
windows AS (SELECT recording_id, floor(floor(d) * f) AS s FROM durations, unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS x(f) WHERE floor(d) >= 24 UNION ALL SELECT recording_id, 0.0 FROM durations WHERE floor(d) < 24),
each AS (SELECT s.recording_id, s.channel, w.s, avg(x * x) AS p, max(abs(x)) AS m FROM samples s JOIN durations d ON d.recording_id = s.recording_id JOIN windows w ON w.recording_id = s.recording_id AND s.t >= w.s AND (floor(d.d) < 24 OR s.t < w.s + 12) GROUP BY ALL),
best AS (SELECT recording_id, channel, max(10 * log10(p)) AS mean_db, max(10 * log10(m * m)) AS max_db FROM each WHERE p > 0 GROUP BY ALL)
SELECT c.recording_id, c.channel, round(coalesce(mean_db, -91.0), 3) AS mean_db, round(coalesce(max_db, -91.0), 3) AS max_db FROM (SELECT DISTINCT recording_id, channel FROM samples) c LEFT JOIN best b ON b.recording_id = c.recording_id AND b.channel = c.channel""")
def sampled_levels(spark, sf_dir):
    samples = fx.audio_samples(spark, sf_dir)
    found = lv.sampled_levels(samples, samples.groupBy("recording_id").agg(F.max("t").alias("duration")))
    return found.select("recording_id", "channel", F.round("mean_db", 3).alias("mean_db"), F.round("max_db", 3).alias("max_db"))


@query(f"{_LEVELS} SELECT recording_id, channel, CASE WHEN mean_db < -55 THEN 'DEAD' ELSE 'OK' END AS verdict FROM levels")
def callcheck_verdict(spark, sf_dir):
    return lv.verdicts(lv.channel_levels(fx.audio_samples(spark, sf_dir))).select("recording_id", "channel", "verdict")


@query(f"{_LEVELS} SELECT recording_id, bool_and(mean_db >= -55) AS passed FROM levels GROUP BY recording_id")
def callcheck_overall(spark, sf_dir):
    return lv.overall(lv.verdicts(lv.channel_levels(fx.audio_samples(spark, sf_dir))))
