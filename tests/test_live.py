"""Live operators against their batch forms, on micro-batches whose rows are shuffled."""

import os

import pytest
from pyspark.sql import functions as F

from callweave.operators import prosody as pr
from callweave.operators import stitch as st
from callweave.operators import timeline as tl
from callweave.sources import fixtures as fx
from callweave.streaming import jobs, live

SF = "/root/testdata/sf0.001"
DAY = 1_700_000_000


def streamed(spark, rows, order, tmp_path, name, run, per_file=40, mixed=17):
    """What ``run`` makes of ``rows`` (with ts), dealt into files out of order by up to ``mixed`` places; and how many states stay."""
    far = rows.limit(1).withColumn("recording_id", F.lit("-1").cast(rows.schema["recording_id"].dataType)).withColumn("ts", F.timestamp_seconds(F.lit(DAY + 40 * 86_400)))
    place = F.floor((F.col(order) + F.abs(F.hash("recording_id", order)) % mixed) / per_file)
    dealt = rows.withColumn("file", F.least(place, F.lit(6)).cast("int")).orderBy(F.rand(3)).unionByName(far.withColumn("file", F.lit(7)))
    dealt.repartition(1).write.partitionBy("file").parquet(str(tmp_path / "all"))
    os.makedirs(tmp_path / "in")
    for n, folder in enumerate(sorted((tmp_path / "all").glob("file=*"))):
        (part,) = folder.glob("*.parquet")
        os.rename(part, tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (DAY + n, DAY + n))
    source = jobs.new_files(spark, str(tmp_path / "in"), rows.schema, per_trigger=1)
    query = run(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return spark.table(name).filter("recording_id <> -1"), states[-1]


def at(seconds):
    return F.timestamp_micros(((F.lit(DAY) + seconds) * 1_000_000).cast("long")).alias("ts")


def test_the_last_line_comes_out_by_the_timer(spark, tmp_path):
    rows = [(1, n, [f"w{n}", f"w{n + 1}"] if n % 3 else [f"w{n}"]) for n in range(1, 120)] + [(2, 1, ["a", "b", "c"]), (3, 5, [])]
    frames = spark.createDataFrame(rows, "recording_id long, frame_no long, lines array<string>").select("*", at(F.col("frame_no") / 2))
    found, states = streamed(spark, frames, "frame_no", tmp_path, "held_lines", lambda s: live.settled_lines(s, late="20 seconds"))
    got = {(r["recording_id"], r["frame_no"]): r["lines"] for r in found.collect()}
    assert got == {(i, n): lines if i > 1 or n == 119 or len(lines) == 1 else lines[:1] for i, n, lines in rows}
    assert states == 1  # that of the row that moves the watermark on


def test_tokens_are_those_of_the_batch(spark, tmp_path):
    frames = fx.caption_windows(spark, SF).filter("recording_id < 8")
    halves = F.array(F.slice("tokens", 1, 12), F.slice("tokens", 13, 100))
    lines = F.filter(halves, lambda x: F.size(x) > 0)
    shown = frames.select("recording_id", F.col("frame_no").cast("long").alias("frame_no"), at(F.col("frame_no") / 2), lines.alias("lines")).cache()
    final = shown.groupBy("recording_id").agg(F.max("frame_no").alias("top"))
    kept = F.when((F.col("frame_no") == F.col("top")) | (F.size("lines") == 1), F.col("lines")).otherwise(F.expr("slice(lines, 1, size(lines) - 1)"))
    batch = st.rolling_merge(shown.join(final, "recording_id").select("recording_id", "frame_no", F.flatten(kept).alias("tokens")))
    found, states = streamed(spark, shown, "frame_no", tmp_path, "live_tokens", lambda s: live.live_tokens(s, late="30 seconds"))
    joined = {}
    for r in found.orderBy("recording_id", "frame_no").collect():
        joined.setdefault(r["recording_id"], []).extend(zip(r["marks"], r["toks"], strict=True))
    assert joined == {r["recording_id"]: [(t["is_spk"], t["tok"]) for t in r["tokens"]] for r in batch.collect()} and states == 1


@pytest.mark.parametrize("mixed", [1, 31])
def test_spans_are_those_of_the_batch(spark, tmp_path, mixed):
    observations = fx.observations(spark, SF)
    timed = observations.select("*", at(F.col("frame_index") / 2))
    found, states = streamed(spark, timed, "frame_index", tmp_path, f"live_spans_{mixed}", lambda s: live.live_spans(s, late="40 seconds"), mixed=mixed)
    names = ["recording_id", "start", "end", "name", "raw_ocr", "unresolved"]
    shape = lambda df: sorted(map(str, df.select(*names).collect()))
    assert shape(found) == shape(tl.spans(observations)) and states == 1


def test_segments_are_those_of_the_batch(spark, tmp_path):
    voiced = fx.voiced_times(spark, SF)
    first = voiced.agg(F.min("t")).first()[0]
    timed = voiced.select("recording_id", "t", at(F.col("t") - first), (F.col("t") - first).alias("nth")).cache()
    options = {"step": 0.01, "silence_bridge": 12, "longest": 48, "shortest": 1}
    found, states = streamed(spark, timed, "nth", tmp_path, "live_segments", lambda s: live.live_segments(s, late="5 minutes", idle="1 hour", **options), per_file=400, mixed=200)
    batch = pr.vad_segments(voiced, order="event_id", **options)
    shape = lambda df: sorted((r["recording_id"], round(r["t_start"], 6), round(r["t_end"], 6)) for r in df.collect())
    assert len(shape(batch)) > 20 and shape(found) == shape(batch) and states == 1


def test_odd_rows(spark, tmp_path):
    rows = [(None, 1, "name", "Dana"), (None, 1, "name", "Dana"), (None, 2, "name", None), (4, None, "gap", None), (4, 7, "gap", None), (5, 3, "unknown", "Gw\"en")]
    observed = spark.createDataFrame(rows, "recording_id long, frame_index long, kind string, who string").select("*", at(F.col("frame_index") / 2))
    found, states = streamed(spark, observed, "frame_index", tmp_path, "odd_rows", lambda s: live.live_spans(s, debounce=0.0))
    assert sorted(map(str, spark.table("odd_rows").select("recording_id", "start", "name", "raw_ocr").filter("recording_id is null or recording_id > 0").collect())) == [
        "Row(recording_id=5, start=1.5, name=None, raw_ocr='Gw\"en')", "Row(recording_id=None, start=0.5, name='Dana', raw_ocr='Dana')", "Row(recording_id=None, start=1.0, name=None, raw_ocr=None)",
    ] and states == 1
