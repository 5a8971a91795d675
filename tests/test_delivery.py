import math

import pytest
from pyspark.sql import functions as F

from callweave.operators import faces as fc
from callweave.operators import levels as lv
from callweave.operators import prosody as pr
from callweave.operators import transcript as tr
from callweave.sources import readers as rd


def test_utterances_end_at_the_next_line(spark):
    rows = [(1, 0, 0, "Caller", "a"), (1, 1, 4, "You", "b"), (1, 2, 4, "Caller", "c"), (1, 3, 60, "Caller", "d")]
    lines = spark.createDataFrame(rows, "recording_id int, line_no int, t long, label string, text string")
    found = pr.utterance_windows(lines).orderBy("line_no").collect()
    assert [(r["t_start"], r["t_end"]) for r in found] == [(0.0, 4.0), (4.0, 19.0), (60.0, 75.0)]


def frames(spark, values, energy=None):
    rows = [(1, i * 0.1, v, energy[i] if energy else 60.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "recording_id int, t double, f0 double, intensity double")


@pytest.mark.parametrize(("values", "sign"), [([150.0 + i for i in range(20)], 1), ([150.0 - i for i in range(20)], -1), ([150.0] * 20, 0)])
def test_slope(spark, values, sign):
    slope = pr.terminal_slope(frames(spark, values), ["recording_id"]).first()["f0_slope"]
    assert (slope > 1e-6) - (slope < -1e-6) == sign


def test_too_few_voiced_frames(spark):
    found = pr.pitch_features(frames(spark, [100.0] * 7 + [None] * 3), ["recording_id"]).first()
    assert found["f0_med"] is None and found["voiced_frac"] == 0.7


def test_energy_between_voiced_frames(spark):
    found = pr.voiced_energy(frames(spark, [None, 100.0, None, 100.0, None], [10.0, 50.0, 60.0, 70.0, 10.0]), ["recording_id"]).first()
    assert found["energy"] == 60.0


def test_short_utterances_do_not_set_the_norm(spark):
    rows = [(1, 2.0, 100.0), (1, 2.0, 110.0), (1, 2.0, 120.0), (1, 0.7, 900.0)]
    df = spark.createDataFrame(rows, "recording_id int, duration double, f0_med double")
    found = pr.zscores(df, ["recording_id"], names=("f0_med",)).orderBy("f0_med").collect()
    assert abs(found[0]["z_f0_med"] + math.sqrt(1.5)) < 1e-9 and found[3]["z_f0_med"] > 50


def test_tag(spark):
    z = {"f0_med": F.lit(1.4), "f0_range": F.lit(0.1), "energy": F.lit(0.9), "rate": F.lit(None).cast("double")}
    assert spark.range(1).select(pr.tag(z, F.lit(55.0))).first()[0] == "{pitch +1.4σ · rising · energy +0.9σ}"
    quiet = dict.fromkeys(z, F.lit(0.0))
    assert spark.range(1).select(pr.tag(quiet, F.lit(0.0))).first()[0] == ""


def test_vad_against_a_loop(spark):
    import random

    rng = random.Random(3)
    rows, expected = [], {}
    for rec in range(30):
        t, times = 0.0, []
        for _ in range(200):
            t = round(t + rng.choice([0.1, 0.1, 0.1, 0.5, 0.6, 0.9]), 3)
            times.append(t)
        rows += [(rec, x) for x in times]
        out, start, prev = [], None, None
        for x in times:
            if start is None:
                start = prev = x
                continue
            if x - prev > 0.6 or x - start > 3.0:
                if prev - start >= 0.8:
                    out.append((start, prev + 0.1))
                start = x
            prev = x
        if prev - start >= 0.8:
            out.append((start, prev + 0.1))
        expected[rec] = out
    df = spark.createDataFrame(rows, "recording_id int, t double")
    found = {}
    for r in pr.vad_segments(df, step=0.1, longest=3.0).orderBy("recording_id", "segment_no").collect():
        found.setdefault(r["recording_id"], []).append((r["t_start"], r["t_end"]))
    assert found == {k: v for k, v in expected.items() if v}


def test_nods(spark):
    wave = [(1, i * 0.5, 0.5, 5.0 if i % 2 else 0.0) for i in range(8)] + [(2, i * 0.5, 0.5, 0.5 if i % 2 else 0.0) for i in range(8)]
    df = spark.createDataFrame(wave, "recording_id int, t double, smile double, pitch_deg double")
    found = {(r["recording_id"], r["t"]): r["nodding"] for r in fc.nods(df).collect()}
    assert found[1, 2.0] and not found[2, 2.0]


def test_smile_and_head_pitch(spark):
    row = spark.createDataFrame([(0.2, None, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 1.0]])], "a double, b double, m array<array<double>>")
    found = row.select(fc.smile(F.col("a"), F.col("b")), fc.head_pitch(F.col("m"))).first()
    assert found[0] == 0.1 and abs(found[1] - 45.0) < 1e-9


def test_few_detections_have_no_norm(spark):
    df = spark.createDataFrame([(1, float(i), 0.5, None) for i in range(9)], "recording_id int, t double, smile double, pitch_deg double")
    found = fc.smile_baseline(df).first()
    assert (found["detected"], found["smile_mean"], found["smile_sd"]) == (9, 0.0, 0.0)
    assert "9/9 frames; baseline smile 0.000" in fc.report(df).first()["text"]


def test_levels(spark):
    rows = [(1, 0, i / 8, 0.5) for i in range(480)] + [(1, 1, i / 8, 0.0) for i in range(480)]
    samples = spark.createDataFrame(rows, "recording_id int, channel int, t double, x double")
    judged = {r["channel"]: r for r in lv.verdicts(lv.channel_levels(samples)).collect()}
    assert abs(judged[0]["mean_db"] + 6.0206) < 1e-3 and judged[0]["verdict"] == "OK"
    assert judged[1]["mean_db"] == float("-inf") and judged[1]["verdict"] == "DEAD"
    durations = spark.createDataFrame([(1, 60.0)], "recording_id int, duration double")
    best = {r["channel"]: r["mean_db"] for r in lv.sampled_levels(samples, durations).collect()}
    assert best[1] == -91.0 and not lv.overall(lv.verdicts(lv.channel_levels(samples))).first()["passed"]


def test_transcript_round_trip(spark):
    texts = spark.createDataFrame([("r", "[0:00:03] [You] hi\nnoise\n[1:01:01] [Dana P] so: [x]\n")], "recording_id string, value string")
    parsed = rd.parse_transcript(texts)
    assert [(r["t"], r["label"], r["text"]) for r in parsed.orderBy("line_no").collect()] == [(3, "You", "hi"), (3661, "Dana P", "so: [x]")]
    assert tr.render(parsed).first()["text"] == "[0:00:03] [You] hi\n[1:01:01] [Dana P] so: [x]\n"


def test_srt(spark):
    left = "1\n00:00:01,500 --> 00:00:02,000\nhello\nthere\n\n2\n00:00:09,000 --> 00:00:10,000\n\n"
    right = "1\n00:00:01,500 --> 00:00:02,000\nyes\n\n"
    texts = spark.createDataFrame([("r", "left", left), ("r", "right", right)], "recording_id string, channel string, value string")
    rows = rd.parse_srt(texts)
    merged = tr.merge_channels(rows.withColumn("label", F.when(F.col("channel") == "left", "You").otherwise("Caller")))
    assert [(r["t"], r["label"], r["text"]) for r in merged.orderBy("line_no").collect()] == [(1, "You", "hello there"), (1, "Caller", "yes")]


def test_files(spark, tmp_path):
    import struct
    import wave

    (tmp_path / "roster.json").write_text('{"self": "Me", "members": [{"canonical": "Dana Park", "aliases": ["D Park"]}, {"canonical": "Eli"}]}')
    names = rd.roster_candidates(rd.roster(spark, str(tmp_path / "roster.json")))
    assert [tuple(r) for r in names.orderBy("member_ord", "candidate").collect()] == [(0, "Dana Park", "D Park"), (0, "Dana Park", "Dana Park"), (1, "Eli", "Eli")]
    with wave.open(str(tmp_path / "call.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(16000)
        f.writeframes(struct.pack("<8h", 1000, 0, 2000, 0, 3000, 0, 4000, 0))
    found = {r["channel"]: r["samples"] for r in rd.wav_samples(spark, str(tmp_path)).collect()}
    assert [round(x * 32768) for x in found[0]] == [1000, 2000, 3000, 4000] and set(found[1]) == {0.0}
    (tmp_path / "ocr" / "call").mkdir(parents=True)
    (tmp_path / "ocr" / "call" / "band_000012.tsv").write_text('level\tpage\tblock\tpar\tline\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t10\t20\t5\t5\t91.5\t"quoted\n5\t1\t1\t1\t1\t2\tx\t20\t5\t5\t91.5\tbad\n')
    ocr = rd.ocr_table(spark, str(tmp_path / "ocr" / "call")).collect()
    assert [(r["recording_id"], r["frame_no"], r["left"], r["conf"], r["word"]) for r in ocr] == [("call", 12, 10, 91.5, '"quoted')]


def test_progress(spark):
    rows = [("r", 0, "[00:00:00.000 --> 00:00:05.000] a"), ("r", 1, "noise"), ("r", 2, "[00:00:05.000 --> 00:00:05.020] b"), ("r", 3, "[00:05.000 --> 01:40.000] c")]
    log = spark.createDataFrame(rows, "recording_id string, line_no int, line string")
    assert [r["percent"] for r in rd.progress_marks(log, 100.0).orderBy("line_no").collect()] == [5, 100]
