import time

from pyspark.sql import functions as F

from callweave.functions.registry import register
from callweave.operators import stitch as st
from callweave.operators import timeline as tl
from callweave.sources import fixtures as fx
from callweave.streaming import jobs

SF = "/root/testdata/sf0.001"


def drained(stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return stream.sparkSession.table(name)


def test_bins(spark, tmp_path):
    samples = fx.face_samples(spark, SF).select("recording_id", F.timestamp_seconds("t").alias("ts"), "smile").filter("recording_id < 8")
    far = samples.agg(F.max("ts").alias("ts")).select(F.lit(99).cast("long").alias("recording_id"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(0.1).alias("smile"))
    samples.unionByName(far).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = jobs.new_files(spark, str(tmp_path / "in"), "recording_id long, ts timestamp, smile double")
    found = drained(jobs.smile_bins(source), "bins", tmp_path)
    wanted = samples.filter("smile is not null").groupBy("recording_id", F.window("ts", "30 seconds").alias("w")).agg(F.count("*").alias("n"), F.avg("smile").alias("m")).filter("n >= 20")
    shape = lambda df: sorted((r[0], r[1], r[2], round(r[3], 6)) for r in df.collect())
    assert shape(found) == shape(wanted.select("recording_id", "w.start", "n", "m"))


def test_sessions(spark, tmp_path):
    rows = [(1, x) for x in (0.0, 0.4, 0.8, 1.2, 5.0, 5.1, 90.0)]
    spark.createDataFrame(rows, "recording_id long, t double").select("recording_id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = jobs.new_files(spark, str(tmp_path / "in"), "recording_id long, ts timestamp")
    found = drained(jobs.voiced_sessions(source), "voiced", tmp_path).select(F.col("start").cast("double"), F.col("end").cast("double")).collect()
    assert [tuple(r) for r in found] == [(0.0, 1.2)]


def test_caption_merge_over_micro_batches(spark, tmp_path):
    frames = fx.caption_windows(spark, SF).filter("recording_id < 6")
    for low, high in ((0, 9), (9, 21), (21, 10_000)):  # files are taken by age
        frames.filter((F.col("frame_no") >= low) & (F.col("frame_no") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    source = jobs.new_files(spark, str(tmp_path / "in"), frames.schema, per_trigger=1)
    found = drained(jobs.committed_tokens(source), "captions", tmp_path)
    joined = {}
    for r in found.orderBy("recording_id", "frame_no").collect():
        joined.setdefault(r["recording_id"], []).extend(r["toks"])
    assert joined == {r["recording_id"]: [t["tok"] for t in r["tokens"]] for r in st.rolling_merge(frames).collect()}


def test_the_line_under_revision_waits(spark, tmp_path):
    rows = [("c", 1, ["a b"], False), ("c", 2, ["a b", "c"], False), ("c", 3, ["c d", "e f"], True), ("c", 4, [], False)]
    spark.createDataFrame(rows, "recording_id string, frame_no long, lines array<string>, final boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = jobs.new_files(spark, str(tmp_path / "in"), "recording_id string, frame_no long, lines array<string>, final boolean")
    found = drained(jobs.held_back(source), "held", tmp_path)
    assert {r["frame_no"]: r["lines"] for r in found.collect()} == {1: ["a b"], 2: ["a b"], 3: ["c d", "e f"], 4: []}


def test_settled_spans_are_those_of_the_batch(spark, tmp_path):
    observations = fx.observations(spark, SF)
    last = observations.groupBy("recording_id").agg(F.max("frame_index").alias("top"))
    marked = observations.join(last, "recording_id").select("recording_id", "frame_index", "kind", "who", (F.col("frame_index") == F.col("top")).alias("final")).cache()
    for low, high in ((0, 11), (11, 37), (37, 10_000)):
        marked.filter((F.col("frame_index") >= low) & (F.col("frame_index") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    source = jobs.new_files(spark, str(tmp_path / "in"), marked.schema, per_trigger=1)
    names = ["recording_id", "start", "end", "name", "raw_ocr", "unresolved"]
    shape = lambda df: sorted(map(str, df.select(*names).collect()))
    assert shape(drained(jobs.settled_spans(source), "spans", tmp_path)) == shape(tl.spans(observations))


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT seq_ratio('Dana Park', 'D4na Park') AS r, dedupe_stutter(array('a', 'b', 'A', 'b', 'c')) AS d, clock(3661) AS c, decibels(0.25D) AS l").first()
    assert round(row["r"], 3) == 0.889 and row["d"] == ["A", "b", "c"] and row["c"] == "1:01:01" and round(row["l"], 2) == -6.02
