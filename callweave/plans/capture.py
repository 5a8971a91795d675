"""Queries of captions: OCR lines, matching, stitching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import captions as cp
from ..operators import match as mt
from ..operators import stitch as st
from ..sources import fixtures as fx

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return add


_JUNK = cp.JUNK.replace("'", "''")
_NAMED = r"""len(list_filter(regexp_split_to_array(trim({x}), '\s+'), lambda w: w <> '')) BETWEEN 1 AND 4 AND NOT regexp_matches(trim({x}), '[.?!,:;]$')
  AND NOT regexp_matches(trim({x}), '[(){}\[\]=<>/]') AND regexp_matches(trim({x}), '(^|\s)\p{Lu}')"""
_GIBBERISH = r"""(len({w}) >= 3 AND len(list_filter({w}, lambda x: regexp_matches(x, '[a-z][A-Z]') OR regexp_matches(x, '^[A-Z]{4,}$') OR (length(x) >= 4 AND NOT regexp_matches(x, '[aeiouAEIOU]')))) / len({w}) > 0.3)"""
_WORDS = r"""list_filter(list_transform(regexp_split_to_array({x}, '\s+'), lambda w: regexp_replace(w, '[^A-Za-z]', '', 'g')), lambda w: w <> '')"""
_DOC_LINES = """docs AS (SELECT doc_id, line_no, trim(l[line_no + 1]) AS raw FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def named(x: str) -> str:
    return _NAMED.replace("{x}", x)


# ---------------------------------------------------------------- SQL of matching: similarity by matching blocks

_BEST = """list_max(flatten(list_transform(range({alo}, {ahi}), lambda i: list_transform(range({blo}, {bhi}), lambda j:
  {{'k': list_max(list_filter(range(0, least({ahi} - i, {bhi} - j) + 1), lambda n: substr(a, i, n) = substr(b, j, n))), 'i': -i, 'j': -j}}))))"""
_MEMBERS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(fx.NAMES))


def _matched_sql(labels: str, label: str) -> str:
    """CTEs ``matches`` (raw, name): each label of ``labels`` with the roster's best name of similarity 0.72 or more, or oneself.

    The similarity is twice the letters in matching blocks by all letters: the longest common run (of equals the first),
    then the same on either side of it.
    """
    return f"""
asked AS (SELECT DISTINCT {label} AS raw, trim({label}) AS clean FROM {labels} WHERE {label} IS NOT NULL),
members(ord, name) AS (VALUES {_MEMBERS}),
pairs AS (SELECT DISTINCT lower(clean) AS a, lower(name) AS b FROM asked, members),
parts AS (
  SELECT a, b, 1::BIGINT AS alo, (length(a) + 1)::BIGINT AS ahi, 1::BIGINT AS blo, (length(b) + 1)::BIGINT AS bhi, {_BEST.format(alo=1, ahi="length(a) + 1", blo=1, bhi="length(b) + 1")} AS best FROM pairs
  UNION ALL
  SELECT a, b, alo, ahi, blo, bhi, {_BEST.format(alo="alo", ahi="ahi", blo="blo", bhi="bhi")} AS best FROM (
    SELECT a, b, unnest([alo, -best.i + best.k]) AS alo, unnest([-best.i, ahi]) AS ahi, unnest([blo, -best.j + best.k]) AS blo, unnest([-best.j, bhi]) AS bhi FROM parts WHERE best.k > 0)
),
ratios AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * sum(coalesce(best.k, 0)) / (length(a) + length(b)) END AS r FROM parts GROUP BY a, b),
ranked AS (SELECT raw, clean, name, r, row_number() OVER (PARTITION BY raw ORDER BY r DESC, ord) AS place FROM asked, members JOIN ratios ON a = lower(clean) AND b = lower(name)),
matches AS (SELECT raw, CASE WHEN lower(clean) = 'you' THEN 'You' WHEN r >= 0.72 THEN name END AS name FROM ranked WHERE place = 1)"""


# ---------------------------------------------------------------- SQL of stitching

_KEY = "regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def _said_once(source: str, group: str, passes: int = 3, longest: int = 8) -> str:
    """CTEs that end in ``once``: the tokens of ``source`` (group, pos, key, ...) without phrases that are said again at once.

    A stretch of L tokens that each equal the one n places on loses its first L - L % n. Longer phrases go first; three
    rounds leave nothing to do in these tables.
    """
    steps, now = [], source
    for i, n in enumerate([n for _ in range(passes) for n in range(longest, 0, -1)]):
        steps.append(f"""s{i}a AS (SELECT *, row_number() OVER w AS rn, coalesce(key <> '' AND key = lead(key, {n}) OVER w, false) AS same FROM {now} WINDOW w AS (PARTITION BY {group} ORDER BY pos)),
s{i}b AS (SELECT *, rn - row_number() OVER (PARTITION BY {group}, same ORDER BY pos) AS isl FROM s{i}a),
s{i} AS (SELECT * EXCLUDE (rn, same, isl, off, len) FROM (SELECT *, row_number() OVER (PARTITION BY {group}, same, isl ORDER BY pos) - 1 AS off, count(*) OVER (PARTITION BY {group}, same, isl) AS len FROM s{i}b)
  WHERE NOT (same AND off < len // {n} * {n}))""")
        now = f"s{i}"
    return ",\n".join([*steps, f"once AS (SELECT * FROM {now})"])


_STITCHED = rf"""WITH words AS (
  SELECT conv_id AS recording_id, turn, 0 AS nth, true AS is_spk, role AS tok FROM conversations
  UNION ALL SELECT conv_id, turn, unnest(range(1, len(w) + 1)), false, unnest(w) FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM conversations)
), numbered AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY turn, nth) AS pos, is_spk, tok AS raw FROM words),
tokens AS (SELECT recording_id, pos, is_spk, tok, CASE WHEN is_spk THEN chr(1) || tok ELSE {_KEY.format(x="tok")} END AS key
  FROM (SELECT *, CASE WHEN is_spk THEN raw WHEN raw = '|' THEN 'I' WHEN regexp_matches(raw, '^\|[''’].*$') THEN replace(raw, '|', 'I') ELSE raw END AS tok FROM numbered)),
{_said_once("tokens", "recording_id")},
spoken AS (SELECT recording_id, pos, tok, speaker FROM (
  SELECT *, coalesce(last_value(CASE WHEN is_spk THEN tok END IGNORE NULLS) OVER (PARTITION BY recording_id ORDER BY pos), '???') AS speaker FROM once) WHERE NOT is_spk),
changes AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY recording_id ORDER BY pos) THEN 1 ELSE 0 END AS change FROM spoken),
turned AS (SELECT *, sum(change) OVER (PARTITION BY recording_id ORDER BY pos)::BIGINT AS turn_no FROM changes),
turns AS (SELECT recording_id, turn_no, min(speaker) AS speaker, string_agg(tok, ' ' ORDER BY pos) AS text FROM turned GROUP BY ALL)"""


def _documents(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("value"))


@query(f"WITH {fx.CAPTIONS_SQL} SELECT recording_id, frame_index, line_no::BIGINT AS line_no, line FROM captions WHERE {named('line')}")
def name_like_lines(spark, sf_dir):
    return fx.caption_frames(spark, sf_dir).filter(cp.name_like(F.col("line"))).withColumn("line_no", F.col("line_no").cast("long"))


@query(rf"""WITH {_DOC_LINES} SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS letters FROM (SELECT doc_id, CASE WHEN regexp_matches(raw, '[A-Z]') THEN regexp_extract(raw, '[A-Z].*$') ELSE raw END AS line FROM docs WHERE raw <> '')
WHERE line NOT IN ('Summarize captions', 'Summarize Captions') GROUP BY doc_id""")
def ocr_line_clean(spark, sf_dir):
    return cp.clean_lines(_documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("letters"))


@query(f"WITH {_DOC_LINES} SELECT doc_id, count(*) AS n FROM docs WHERE NOT regexp_matches(raw, '(?i){_JUNK}') GROUP BY doc_id")
def junk_filter(spark, sf_dir):
    lines = _documents(spark, sf_dir).select("doc_id", F.explode(F.split("value", "\n")).alias("raw"))
    return lines.filter(~cp.junk(F.col("raw"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {_DOC_LINES} SELECT doc_id, count(*) AS n, count(*) FILTER ({_GIBBERISH.replace('{w}', 'w')}) AS odd FROM (SELECT doc_id, {_WORDS.replace('{x}', 'raw')} AS w FROM docs) GROUP BY doc_id")
def gibberish_filter(spark, sf_dir):
    lines = _documents(spark, sf_dir).select("doc_id", F.explode(F.split("value", "\n")).alias("raw"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(cp.gibberish(F.trim("raw"))).alias("odd"))


@query(f"WITH {fx.CAPTIONS_SQL} SELECT recording_id, frame_index, arg_max(trim(line), line_no) AS raw FROM captions WHERE {named('line')} GROUP BY ALL")
def bottom_speaker(spark, sf_dir):
    return cp.bottom_label(fx.caption_frames(spark, sf_dir), ["recording_id", "frame_index"])


_LINES_SQL = rf"""WITH {fx.CAPTIONS_SQL}, {fx.OCR_SQL},
built AS (SELECT recording_id, frame_no, line_no AS src, min(row_no) AS first, list_sort(list(top))[len(list(top)) // 2 + 1] AS top, string_agg(word, ' ' ORDER BY "left", row_no) AS text FROM ocr WHERE conf >= 70 GROUP BY ALL),
legible AS (SELECT *, {_WORDS.replace("{x}", "text")} AS w FROM built WHERE length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) >= 2 AND NOT regexp_matches(text, '(?i){_JUNK}'))
SELECT recording_id, frame_no, row_number() OVER (PARTITION BY recording_id, frame_no ORDER BY top, first) - 1 AS line_no, top, text FROM legible WHERE NOT {_GIBBERISH.replace("{w}", "w")}"""


@query(_LINES_SQL)
def ocr_line_assembly(spark, sf_dir):
    found = cp.caption_lines(fx.ocr_words(spark, sf_dir))
    return found.select("recording_id", "frame_no", F.col("line_no").cast("long").alias("line_no"), F.col("top").cast("long").alias("top"), "text")


@query(f"""WITH RECURSIVE {fx.CAPTIONS_SQL}, shown AS (SELECT * FROM captions WHERE line_no = 0), {_matched_sql("shown", "line")}
SELECT c.recording_id, c.frame_index, c.line AS raw, m.name FROM shown c LEFT JOIN matches m ON m.raw = c.line""")
def roster_match(spark, sf_dir):
    labels = fx.caption_frames(spark, sf_dir).filter("line_no = 0").select("recording_id", "frame_index", F.col("line").alias("raw"))
    found = mt.match_labels(labels, fx.roster_candidates(spark))
    return labels.join(found.select("raw", "name"), "raw", "left").select("recording_id", "frame_index", "raw", "name")


def _speakers_sql(lines: str, text: str) -> str:
    """CTEs ``speakers`` (text, name): lines that are a name of at most four words."""
    return rf"""keyed AS (SELECT text, key FROM (SELECT text, trim(regexp_replace(lower(text), '[^a-z'' ]', '', 'g')) AS key FROM (SELECT DISTINCT {text} AS text FROM {lines})) WHERE key <> '' AND len(regexp_split_to_array(key, '\s+')) <= 4),
{_matched_sql("keyed", "key")},
speakers AS (SELECT k.text, m.name FROM keyed k JOIN matches m ON m.raw = k.key WHERE m.name IS NOT NULL)"""


@query(f"WITH RECURSIVE {fx.CAPTIONS_SQL}, {_speakers_sql('captions', 'line')} SELECT * FROM speakers")
def caption_speaker(spark, sf_dir):
    lines = fx.caption_frames(spark, sf_dir).withColumnRenamed("line", "text")
    return mt.caption_speakers(lines, fx.roster_candidates(spark))


@query(f"""WITH RECURSIVE {fx.CAPTIONS_SQL}, labels AS (SELECT recording_id, frame_index, arg_max(trim(line), line_no) AS raw FROM captions WHERE {named("line")} GROUP BY ALL), {_matched_sql("labels", "raw")},
seen AS (SELECT f.recording_id, f.frame_index, CASE WHEN f.frame_index % 7 <> 6 THEN m.name END AS name, CASE WHEN f.frame_index % 7 <> 6 THEN l.raw END AS raw
  FROM (SELECT DISTINCT recording_id, frame_index FROM captions) f LEFT JOIN labels l ON l.recording_id = f.recording_id AND l.frame_index = f.frame_index LEFT JOIN matches m ON m.raw = l.raw)
SELECT recording_id, frame_index, CASE WHEN name IS NOT NULL THEN 'name' WHEN raw IS NOT NULL THEN 'unknown' ELSE 'gap' END AS kind, coalesce(name, raw) AS who FROM seen""")
def matched_observations(spark, sf_dir):
    """OCR lines to observations: the lowest label of each frame, matched to the roster."""
    labels = cp.bottom_label(fx.caption_frames(spark, sf_dir), ["recording_id", "frame_index"])
    frames = fx.caption_frames(spark, sf_dir).select("recording_id", "frame_index").distinct().withColumn("band_present", F.col("frame_index") % 7 != 6)
    return cp.observations(frames, labels, mt.match_labels(labels, fx.roster_candidates(spark)))


@query("""WITH pixels AS (SELECT vec_id // 10 AS recording_id, vec_id AS frame_index, floor(abs(embedding[i + 1]::DOUBLE) * 600) AS gray FROM (SELECT *, unnest(range(0, len(embedding))) AS i FROM embeddings))
SELECT recording_id, frame_index, avg((gray < 90)::INTEGER) >= 0.35 AS band_present FROM pixels GROUP BY ALL""")
def band_present(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("recording_id"), F.col("vec_id").alias("frame_index"), F.explode("embedding").alias("v"))
    return cp.band_present(rows.select("recording_id", "frame_index", F.floor(F.abs(F.col("v").cast("double")) * 600).alias("gray")))


@query("""SELECT conv_id AS recording_id, string_agg(role || ' ' || array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), ' '), ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def rolling_merge(spark, sf_dir):
    """The fold over sliding windows gives back the text they were cut from."""
    merged = st.rolling_merge(fx.caption_windows(spark, sf_dir))
    return merged.select("recording_id", F.array_join(F.col("tokens.tok"), " ").alias("text"))


@query(None)
def revised_merge(spark, sf_dir):
    """The fold over frames whose words are cut short, misread and corrected, in chunks; a test folds them plainly."""
    merged = st.rolling_merge(fx.revised_windows(spark, sf_dir), chunk_frames=64, warm_frames=24)
    return merged.select("recording_id", "n_frames", F.size("tokens").cast("long").alias("n"), F.array_join(F.col("tokens.tok"), " ").alias("text"))


@query(rf"""WITH words AS (
  SELECT conv_id AS recording_id, turn, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS tok FROM (SELECT conv_id, turn, regexp_split_to_array(text, '\s+') AS w FROM conversations)
), tokens AS (SELECT *, {_KEY.format(x="tok")} AS key FROM words), {_said_once("tokens", "recording_id, turn")}
SELECT recording_id, turn, count(*) AS n, string_agg(tok, ' ' ORDER BY pos) AS text FROM once GROUP BY ALL""")
def stutter_dedupe(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording_id"), "turn", F.transform(F.split("text", r"\s+"), lambda w: F.struct(F.lit(False).alias("is_spk"), w.alias("tok"))).alias("tokens"))
    return st.without_stutter(rows).select("recording_id", "turn", F.size("tokens").cast("long").alias("n"), F.array_join(F.col("tokens.tok"), " ").alias("text"))


@query(f"{_STITCHED} SELECT * FROM turns")
def stitched_turns(spark, sf_dir):
    return st.turns(st.stitched(fx.caption_windows(spark, sf_dir)))


@query(f"""{_STITCHED}, sizes AS (SELECT recording_id, count(*) AS n FROM numbered GROUP BY ALL)
SELECT s.recording_id, greatest(0, ceil((s.n - 20) / 5))::BIGINT + 1 AS frames, count(*) AS tokens, (SELECT count(*) FROM turns t WHERE t.recording_id = s.recording_id) AS turns
FROM sizes s JOIN once o ON o.recording_id = s.recording_id GROUP BY s.recording_id, s.n""")
def stitch_stats(spark, sf_dir):
    done = st.stitched(fx.caption_windows(spark, sf_dir))
    return st.stitch_stats(done, st.turns(done))


@query(f"""{_STITCHED} SELECT recording_id, regexp_replace(regexp_replace(string_agg(speaker || ': ' || text, chr(10) || chr(10) ORDER BY turn_no), 'assistant:', 'Guest:', 'g'), 'user:', 'You:', 'g') AS text
FROM turns GROUP BY recording_id""")
def stitched_text(spark, sf_dir):
    return st.stitched_texts(st.turns(st.stitched(fx.caption_windows(spark, sf_dir))), (("assistant:", "Guest:"), ("user:", "You:")))


@query(rf"""{_LINES_SQL.replace("WITH", "WITH RECURSIVE", 1).replace("SELECT recording_id, frame_no, row_number()", ", lines AS (SELECT recording_id, frame_no, row_number()", 1)}),
{_speakers_sql("lines", "text")},
marked AS (SELECT *, count(*) OVER (PARTITION BY recording_id, frame_no) AS n, max(line_no) OVER (PARTITION BY recording_id, frame_no) AS low, max(frame_no) OVER (PARTITION BY recording_id) AS final FROM lines),
kept AS (SELECT m.*, s.name FROM marked m LEFT JOIN speakers s ON s.text = m.text WHERE m.frame_no = m.final OR m.n = 1 OR m.line_no < m.low)
SELECT recording_id, frame_no, string_agg(coalesce(name, text), ' ' ORDER BY line_no) AS text FROM kept GROUP BY ALL""")
def frame_tokens(spark, sf_dir):
    lines = cp.caption_lines(fx.ocr_words(spark, sf_dir))
    return st.frame_tokens(lines, mt.caption_speakers(lines, fx.roster_candidates(spark))).select("recording_id", "frame_no", F.array_join(F.col("tokens.tok"), " ").alias("text"))
