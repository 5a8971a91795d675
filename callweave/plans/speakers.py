"""Queries of timelines, attribution and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as att
from ..operators import timeline as tl
from ..operators import transcript as tr
from ..sources import fixtures as fx
from ..sources import readers as rd

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


# ---------------------------------------------------------------- SQL of the timeline, step by step

_RUNS = f"""WITH {fx.OBSERVATIONS_SQL},
marked AS (SELECT *, frame_index / 2.0::DOUBLE AS t,
  CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND who IS NOT DISTINCT FROM lag(who) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS chg
  FROM obs WINDOW w AS (PARTITION BY recording_id ORDER BY frame_index)),
numbered AS (SELECT *, sum(chg) OVER (PARTITION BY recording_id ORDER BY frame_index)::BIGINT AS run_no FROM marked),
runs AS (SELECT recording_id, run_no, min(t) AS start, max(t + 0.5) AS "end", min(kind) AS kind, min(who) AS who FROM numbered GROUP BY ALL)"""

_GROUP = """
{name}_b AS (SELECT *, {begins} AS begins FROM {source} WINDOW w AS (PARTITION BY recording_id ORDER BY run_no)),
{name}_g AS (SELECT *, sum(begins) OVER (PARTITION BY recording_id ORDER BY run_no)::BIGINT AS grp FROM {name}_b),
{name} AS (SELECT recording_id, grp AS run_no, min(start) AS start, arg_max("end", run_no) AS "end", arg_min(kind, run_no) AS kind, first(who ORDER BY run_no) AS who FROM {name}_g GROUP BY recording_id, grp)"""

_DEBOUNCED = _RUNS + "," + _GROUP.format(name="debounced", source="runs", begins="CASE WHEN kind <> 'gap' AND \"end\" - start < 1.0 AND coalesce(lag(kind) OVER w, 'gap') <> 'gap' THEN 0 ELSE 1 END")
_COLLAPSED = _DEBOUNCED + "," + _GROUP.format(name="collapsed", source="debounced", begins="CASE WHEN kind = lag(kind) OVER w AND who IS NOT DISTINCT FROM lag(who) OVER w THEN 0 ELSE 1 END")
_SPANS = (
    _COLLAPSED
    + """,
absorbing AS (SELECT *, coalesce(kind = 'gap' AND "end" - start < 3.0 AND lag(kind) OVER w = 'name' AND lead(kind) OVER w = 'name' AND lag(who) OVER w = lead(who) OVER w, false) AS absorb
  FROM collapsed WINDOW w AS (PARTITION BY recording_id ORDER BY run_no)),"""
    + _GROUP.format(name="bridged", source="absorbing", begins="CASE WHEN absorb OR coalesce(lag(absorb) OVER w, false) THEN 0 ELSE 1 END")
    + """,
spans AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY run_no) AS span_no, round(start, 3) AS start, round("end", 3) AS "end",
  CASE WHEN kind = 'name' THEN who END AS name, who AS raw_ocr, 1.0::DOUBLE AS confidence, kind <> 'name' AS unresolved FROM bridged WHERE kind <> 'gap')"""
)
_RUN_COLUMNS = 'recording_id, run_no, start, "end", kind, who'
_LINES = "WITH " + fx.OBSERVATIONS_SQL.split("frames AS", 1)[0].rstrip().rstrip(",") + "," + fx.TRANSCRIPT_SQL
_BOTH = _SPANS + "," + fx.TRANSCRIPT_SQL
_TIMED = (
    _BOTH
    + """,
inside AS (SELECT l.recording_id, l.line_no, first(s.name ORDER BY s.span_no) AS name FROM lines l JOIN spans s ON s.recording_id = l.recording_id AND s.start <= l.t - 1.5 AND l.t - 1.5 < s."end" WHERE l.label = 'Caller' GROUP BY ALL),
timed AS (SELECT l.recording_id, l.line_no, l.t, CASE WHEN l.label = 'Caller' AND i.name <> '' AND i.name <> 'You' THEN i.name ELSE l.label END AS label, l.text, l.label AS original_label
  FROM lines l LEFT JOIN inside i ON i.recording_id = l.recording_id AND i.line_no = l.line_no)"""
)
_MODE = """,
named AS (SELECT recording_id, list_sort(list(DISTINCT name) FILTER (name <> '' AND name <> 'You')) AS others FROM spans GROUP BY recording_id),
modes AS (SELECT r.recording_id, coalesce(n.others, []) AS others, CASE WHEN len(n.others) = 1 THEN 'collapse' ELSE 'timed' END AS mode, CASE WHEN len(n.others) = 1 THEN n.others[1] END AS speaker
  FROM (SELECT DISTINCT recording_id FROM lines) r LEFT JOIN named n ON n.recording_id = r.recording_id)"""
_RESOLVED = (
    _TIMED
    + _MODE
    + """,
resolved AS (SELECT t.recording_id, t.line_no, t.t, CASE WHEN mode = 'collapse' THEN CASE WHEN original_label = 'Caller' THEN speaker ELSE original_label END ELSE label END AS label, text, original_label, mode
  FROM timed t JOIN modes m ON m.recording_id = t.recording_id)"""
)
_REVIEW = """,
firsts AS (SELECT recording_id, raw_ocr, min(span_no) AS first_span FROM spans WHERE unresolved GROUP BY ALL),
unknowns AS (SELECT recording_id, raw_ocr, first_span, format('unknown_{:02d}', row_number() OVER (PARTITION BY recording_id ORDER BY first_span)) AS review_id FROM firsts),
reviewed AS (SELECT s.*, u.review_id FROM spans s LEFT JOIN unknowns u ON u.recording_id = s.recording_id AND u.raw_ocr IS NOT DISTINCT FROM s.raw_ocr AND s.unresolved)"""
_MAPPED = _SPANS + _REVIEW + ", answers AS (SELECT recording_id, review_id, concat('Person ', recording_id::VARCHAR) AS answer FROM unknowns WHERE review_id = 'unknown_01' AND recording_id % 2 = 0)"
_ANSWERED = """ SELECT r.recording_id, span_no, start, "end", coalesce(a.answer, name) AS name, raw_ocr, confidence, unresolved AND a.answer IS NULL {bail} AS unresolved, r.review_id
FROM reviewed r LEFT JOIN answers a ON a.recording_id = r.recording_id AND a.review_id = r.review_id"""


# ---------------------------------------------------------------- timeline


@query(f"{_RUNS} SELECT {_RUN_COLUMNS} FROM runs")
def observation_runs(spark, sf_dir):
    return tl.runs(fx.observations(spark, sf_dir)).select(*tl.RUN)


@query(f"{_DEBOUNCED} SELECT {_RUN_COLUMNS} FROM debounced")
def debounced_runs(spark, sf_dir):
    return tl.debounce(tl.runs(fx.observations(spark, sf_dir)))


@query(f"{_COLLAPSED} SELECT {_RUN_COLUMNS} FROM collapsed")
def collapsed_runs(spark, sf_dir):
    return tl.recollapse(tl.debounce(tl.runs(fx.observations(spark, sf_dir))))


def _spans(spark, sf_dir):
    return tl.spans(fx.observations(spark, sf_dir))


@query(f"{_SPANS} SELECT * FROM spans")
def timeline_spans(spark, sf_dir):
    return _spans(spark, sf_dir)


# ---------------------------------------------------------------- attribution


@query(f"{_SPANS} SELECT recording_id, array_to_string(coalesce(list_sort(list(DISTINCT name) FILTER (name <> '' AND name <> 'You')), []), '|') AS others FROM spans GROUP BY recording_id")
def distinct_speakers(spark, sf_dir):
    return att.distinct_speakers(_spans(spark, sf_dir)).select("recording_id", F.array_join("others", "|").alias("others"))


@query(f"{_BOTH}{_MODE} SELECT recording_id, mode, speaker, array_to_string(others, '|') AS others FROM modes")
def attribution_mode(spark, sf_dir):
    found = att.attribution_mode(fx.transcript(spark, sf_dir), _spans(spark, sf_dir))
    return found.select("recording_id", "mode", "speaker", F.array_join("others", "|").alias("others"))


@query(f"""{_BOTH}{_MODE} SELECT recording_id, mode = 'collapse' AS collapsed, CASE WHEN mode <> 'collapse' THEN
  '--callers 1 but ' || len(others) || ' named speakers detected (' || CASE WHEN len(others) = 0 THEN 'none' ELSE '[''' || array_to_string(others, ''', ''') || ''']' END || '); using timed attribution' END AS warning FROM modes""")
def attribution_warning(spark, sf_dir):
    found = att.attribution_mode(fx.transcript(spark, sf_dir), _spans(spark, sf_dir), callers=1)
    return found.select("recording_id", (F.col("mode") == "collapse").alias("collapsed"), "warning")


@query(f"{_TIMED} SELECT * FROM timed")
def relabel_timed(spark, sf_dir):
    return att.relabel_timed(fx.transcript(spark, sf_dir), _spans(spark, sf_dir))


@query(f"{_RESOLVED} SELECT * FROM resolved")
def relabel_resolved(spark, sf_dir):
    return att.resolve(fx.transcript(spark, sf_dir), _spans(spark, sf_dir))


@query(f"""{_BOTH}{_MODE} SELECT l.recording_id, line_no, t, CASE WHEN label = 'Caller' AND speaker IS NOT NULL THEN speaker ELSE label END AS label, text, label AS original_label
FROM lines l JOIN modes m ON m.recording_id = l.recording_id""")
def collapse_caller(spark, sf_dir):
    lines = fx.transcript(spark, sf_dir)
    return att.collapse_caller(lines, att.attribution_mode(lines, _spans(spark, sf_dir)))


_COVERED = """ SELECT recording_id, count(*) FILTER (original_label = 'Caller') AS caller_lines, count(*) FILTER (original_label = 'Caller' AND label <> 'Caller') AS attributed_lines,
  CASE WHEN count(*) FILTER (original_label = 'Caller') = 0 THEN 0.0::DOUBLE ELSE round_even(count(*) FILTER (original_label = 'Caller' AND label <> 'Caller') / count(*) FILTER (original_label = 'Caller') * 100, 1) END AS attributed_pct
FROM resolved GROUP BY recording_id"""


@query(_RESOLVED + _COVERED)
def coverage_by_recording(spark, sf_dir):
    return att.coverage(relabel_resolved(spark, sf_dir)).drop("lost_lines")


@query(f"{_RESOLVED} SELECT recording_id, t, text FROM resolved WHERE original_label = 'Caller' AND label = 'Caller'")
def lost_lines(spark, sf_dir):
    return att.coverage(relabel_resolved(spark, sf_dir)).select("recording_id", F.inline("lost_lines").alias("t", "text"))


# ---------------------------------------------------------------- review


@query(f"{_SPANS}{_REVIEW} SELECT recording_id, review_id, raw_ocr, first_span FROM unknowns")
def review_unknowns(spark, sf_dir):
    return att.unknowns(_spans(spark, sf_dir))


def _answers(spans):
    first = att.unknowns(spans).filter("review_id = 'unknown_01' and recording_id % 2 = 0")
    return first.select("recording_id", "review_id", F.concat(F.lit("Person "), F.col("recording_id").cast("string")).alias("answer"))


@query(_MAPPED + _ANSWERED.format(bail=""))
def review_reconcile(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return att.reconcile(att.with_review_ids(spans), _answers(spans))


@query(_MAPPED + _ANSWERED.format(bail="AND false"))
def review_bail(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return att.reconcile(att.with_review_ids(spans), _answers(spans), bail=True)


@query(f"""{_SPANS}{_REVIEW}, starts AS (SELECT u.recording_id, u.review_id, u.raw_ocr, s.start FROM unknowns u JOIN spans s ON s.recording_id = u.recording_id AND s.span_no = u.first_span)
SELECT recording_id, review_id, raw_ocr, first(frame_index ORDER BY d, frame_index) AS frame_index
FROM (SELECT s.*, o.frame_index, abs((o.frame_index - 1) / 2.0::DOUBLE - s.start) AS d FROM starts s JOIN obs o ON o.recording_id = s.recording_id) GROUP BY recording_id, review_id, raw_ocr""")
def nearest_frame_for_unknown(spark, sf_dir):
    return att.review_manifest(_spans(spark, sf_dir), fx.observations(spark, sf_dir))


# ---------------------------------------------------------------- transcripts


@query(f"{_LINES} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY line_no) AS line_no, t, label, text FROM lines")
def transcript_parse(spark, sf_dir):
    return rd.parse_transcript(fx.transcript_texts(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT DISTINCT conv_id AS recording_id, 'recorded today' AS line FROM conversations")
def transcript_rejected(spark, sf_dir):
    return rd.rejected_lines(fx.transcript_texts(spark, sf_dir)).select("recording_id", "line")


@query(f"""{_LINES} SELECT recording_id, string_agg(format('[{{}}:{{:02d}}:{{:02d}}] [{{}}] {{}}', t // 3600, t % 3600 // 60, t % 60, label, text) || chr(10), '' ORDER BY line_no) AS text
FROM lines GROUP BY recording_id""")
def transcript_render(spark, sf_dir):
    return tr.render(fx.transcript(spark, sf_dir))


@query(f"{_LINES},{fx.SRT_SQL} SELECT recording_id, channel, block_no, round(t, 3) AS t, text FROM segments")
def srt_parse(spark, sf_dir):
    found = rd.parse_srt(fx.srt_texts(spark, sf_dir))
    return found.select("recording_id", "channel", F.col("block_no").cast("long").alias("block_no"), F.round("t", 3).alias("t"), "text")


def _segments(spark, sf_dir):
    found = rd.parse_srt(fx.srt_texts(spark, sf_dir))
    return found.withColumn("label", F.when(F.col("channel") == "left", "You").otherwise("Caller"))


@query(f"""{_LINES},{fx.SRT_SQL} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY round(t, 3), channel, block_no) AS line_no, floor(t)::BIGINT AS t, label, text FROM segments""")
def srt_merge(spark, sf_dir):
    return tr.merge_channels(_segments(spark, sf_dir).withColumn("t", F.round("t", 3)))


@query(f"{_LINES},{fx.SRT_SQL} SELECT recording_id, count(DISTINCT channel) AS channels FROM segments GROUP BY recording_id HAVING count(DISTINCT channel) = 2")
def both_channels_present(spark, sf_dir):
    return rd.both_channels(_segments(spark, sf_dir))


@query("SELECT DISTINCT conv_id AS recording_id FROM conversations WHERE conv_id % 3 <> 0")
def incremental_skip(spark, sf_dir):
    inputs = fx.transcript_texts(spark, sf_dir)
    return rd.not_yet_done(inputs, inputs.filter("recording_id % 3 = 0")).select("recording_id")


@query(f"{_LINES} SELECT recording_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS words FROM lines GROUP BY recording_id")
def transcript_words(spark, sf_dir):
    return fx.transcript(spark, sf_dir).groupBy("recording_id").agg(F.sum(tr.word_count(F.col("text"))).alias("words"))


@query("""SELECT conv_id AS recording_id, turn, CASE role WHEN 'user' THEN 'left' ELSE 'right' END AS channel,
  'calls/' || conv_id || '-' || role || '-prosody.txt' AS prosody, 'calls/' || conv_id || '-faces.txt' AS faces, 'transcripts/' || conv_id || '-stitched.txt' AS stitched FROM conversations""")
def output_paths(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("calls/"), F.col("conv_id").cast("string"), F.lit(".txt"))
    return rows.select(F.col("conv_id").alias("recording_id"), "turn", tr.channel_of(F.col("role"), "user").alias("channel"), tr.prosody_path(path, F.upper("role")).alias("prosody"), tr.faces_path(path).alias("faces"), tr.stitched_path(path).alias("stitched"))


@query("SELECT count(*) AS total, count(*) FILTER (turn % 3 = 0) AS skipped, count(*) FILTER (turn % 3 = 1) AS failed FROM conversations")
def batch_summary(spark, sf_dir):
    turn = F.col("turn") % 3
    return tr.batch_summary(fx.table(spark, sf_dir, "conversations").select(F.when(turn == 0, "skipped").when(turn == 1, "failed").otherwise("done").alias("status")))
