import struct
import wave

import pytest
from pyspark.sql import functions as F

from callweave.cli import main, parser
from callweave.operators import transcript as tr
from callweave.operators import faces as fc
from callweave.operators import levels as lv
from callweave.sources import fixtures as fx
from callweave.sources import readers as rd

SF = "/root/testdata/sf0.001"


def read(spark, path):
    return {r["recording_id"]: r["value"] for r in spark.read.text(str(path), wholetext=True).collect()}


def test_usage():
    with pytest.raises(SystemExit) as e:
        parser().parse_args(["attribute"])
    assert e.value.code == 2


def test_transcribe_then_attribute(spark, tmp_path):
    for side, text in (("left", "1\n00:00:03,000 --> 00:00:04,000\nhello\n\n"), ("right", "1\n00:00:05,900 --> 00:00:07,000\nhi you\n\n")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "call.srt").write_text(text)
    assert main(["transcribe", "--left", str(tmp_path / "left"), "--right", str(tmp_path / "right"), "--out", str(tmp_path / "t")]) == 0
    text = read(spark, tmp_path / "t")["call"]
    assert text.strip() == "[0:00:03] [You] hello\n[0:00:05] [Caller] hi you"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "call.txt").write_text(text)
    rows = [("call", i, "name", "Dana" if i > 5 else "You") for i in range(20)]
    spark.createDataFrame(rows, "recording_id string, frame_index long, kind string, who string").write.parquet(str(tmp_path / "obs"))
    assert main(["attribute", "--observations", str(tmp_path / "obs"), "--transcript", str(tmp_path / "in"), "--out", str(tmp_path / "o")]) == 0
    assert "[Dana] hi you" in read(spark, tmp_path / "o" / "transcripts")["call"]
    assert spark.read.json(str(tmp_path / "o" / "coverage")).first()["attributed_pct"] == 100.0


def test_attribute_from_caption_lines_and_roster(spark, tmp_path):
    (tmp_path / "roster.json").write_text('{"self": "You", "members": [{"canonical": "Dana Park", "aliases": ["Dana"]}]}')
    said = [(i, "You" if i < 8 else "D4na Park" if i < 20 else None) for i in range(24)]
    rows = [("call", i, 0, name, i != 12) for i, name in said] + [("call", i, 1, "well, that is what they said.", i != 12) for i, _ in said]
    spark.createDataFrame(rows, "recording_id string, frame_index long, line_no int, line string, band_present boolean").write.parquet(str(tmp_path / "lines"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "call.txt").write_text("[0:00:03] [You] hello\n[0:00:07] [Caller] hi you\n[0:00:30] [Caller] gone\n")
    command = ["attribute", "--captions", str(tmp_path / "lines"), "--out", str(tmp_path / "o"), "--transcript", str(tmp_path / "in"), "--callers", "2"]
    assert main(command) == 2  # a roster is needed
    assert main([*command, "--roster", str(tmp_path / "roster.json"), "--region", "1,2,3"]) == 2
    assert main([*command, "--roster", str(tmp_path / "roster.json"), "--region", "1,2,3,4"]) == 0
    assert read(spark, tmp_path / "o" / "transcripts")["call"].strip().split("\n") == ["[0:00:03] [You] hello", "[0:00:07] [Dana Park] hi you", "[0:00:30] [Caller] gone"]
    spans = tr.read_spans(spark, str(tmp_path / "o" / "spans")).orderBy("span_no").collect()
    assert [(s["start"], s["end"], s["name"]) for s in spans] == [(0.0, 4.0, "You"), (4.0, 10.0, "Dana Park")]


def test_batches_skip_and_count(spark, tmp_path, capsys):
    block = "1\n00:00:03,000 --> 00:00:04,000\nhello\n\n"
    for side, names in (("left", "abc"), ("right", "ab")):
        (tmp_path / side).mkdir()
        for name in names:
            (tmp_path / side / f"{name}.srt").write_text(block)
    (tmp_path / "done").mkdir()
    (tmp_path / "done" / "a.txt").write_text("x")
    command = ["transcribe", "--left", str(tmp_path / "left"), "--right", str(tmp_path / "right"), "--out", str(tmp_path / "t"), "--done", str(tmp_path / "done"), "--list", str(tmp_path / "l"), "--descending"]
    assert main(command) == 0
    assert "3 files  |  1 skipped  |  1 failed" in capsys.readouterr().out and set(read(spark, tmp_path / "t")) == {"b"}
    listed = spark.read.option("header", True).csv(str(tmp_path / "l")).collect()
    assert [(r["recording_id"], r["status"]) for r in listed] == [("c", "failed"), ("b", "done"), ("a", "skipped")]


def test_affect_from_pitch_frames(spark, tmp_path):
    lines = [f"[0:00:{3 * i:02d}] [{'Caller' if i % 2 else 'You'}] some words of line {i}" for i in range(16)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "call.txt").write_text("\n".join(lines) + "\n")
    frames = [("call", side, i / 10, (200.0 if 90 <= i < 120 and side == "right" else 100.0) + i % 3, 50.0) for i in range(480) for side in ("left", "right")]
    spark.createDataFrame(frames, "recording_id string, channel string, t double, f0 double, intensity double").write.parquet(str(tmp_path / "f"))
    command = ["affect", "--transcript", str(tmp_path / "in"), "--out"]
    assert main([*command, str(tmp_path / "x")]) == 2
    assert main([*command, str(tmp_path / "o"), "--frames", str(tmp_path / "f")]) == 0
    text = read(spark, tmp_path / "o" / "transcripts")["call"].strip().split("\n")
    assert len(text) == 8 and "pitch +" in text[1] and text[1].startswith("[0:00:09]")
    assert main([*command, str(tmp_path / "o2"), "--frames", str(tmp_path / "f"), "--channel", "left"]) == 0
    assert "pitch +2" not in read(spark, tmp_path / "o2" / "transcripts")["call"]
    assert main([*command, str(tmp_path / "o3"), "--frames", str(tmp_path / "f"), "--label", "Nobody"]) == 1


def test_faces(spark, tmp_path):
    fx.face_samples(spark, SF).filter("recording_id < 3").write.parquet(str(tmp_path / "s"))
    assert main(["faces", "--samples", str(tmp_path / "s"), "--out", str(tmp_path / "o"), "--tile", "1,2,3"]) == 2
    assert main(["faces", "--samples", str(tmp_path / "s"), "--out", str(tmp_path / "o"), "--tile", "1,2,3,4"]) == 0
    assert spark.read.text(str(tmp_path / "o")).count() > 3


def test_affect_with_faces(spark, tmp_path):
    """One command: reports alone, reports beside annotated transcripts, samples numbered by frame."""
    samples = fx.face_samples(spark, SF).filter("recording_id < 3")
    samples.write.parquet(str(tmp_path / "s"))
    samples.withColumn("frame_index", F.round(F.col("t") * 2).cast("long")).filter("abs(frame_index - t * 2) < 1e-9").write.parquet(str(tmp_path / "timed"))
    spark.read.parquet(str(tmp_path / "timed")).drop("t").write.parquet(str(tmp_path / "counted"))
    samples.limit(0).write.parquet(str(tmp_path / "none"))

    def reports(folder):
        return sorted((r["recording_id"], r["value"]) for r in spark.read.text(str(folder)).collect())

    assert main(["faces", "--samples", str(tmp_path / "s"), "--out", str(tmp_path / "o")]) == 0
    assert main(["affect", "--faces", str(tmp_path / "s"), "--out", str(tmp_path / "o1"), "--tile", "1,2,3"]) == 2
    assert main(["affect", "--faces", str(tmp_path / "s"), "--out", str(tmp_path / "o1"), "--tile", "1,2,3,4"]) == 0
    assert reports(tmp_path / "o1" / "faces") == reports(tmp_path / "o")
    assert not (tmp_path / "o1" / "transcripts").exists()
    for name in ("timed", "counted"):
        assert main(["affect", "--faces", str(tmp_path / name), "--out", str(tmp_path / f"o-{name}"), "--faces-fps", "2"]) == 0
    assert len(reports(tmp_path / "o-timed" / "faces")) > 3
    assert reports(tmp_path / "o-timed" / "faces") == reports(tmp_path / "o-counted" / "faces")
    assert main(["affect", "--faces", str(tmp_path / "none"), "--out", str(tmp_path / "o2")]) == 1
    assert main(["affect", "--out", str(tmp_path / "o2")]) == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "call.txt").write_text("".join(f"[0:00:{3 * i:02d}] [Caller] some words of line {i}\n" for i in range(16)))
    pitch = [("call", "right", i / 10, 100.0 + i % 7, 50.0) for i in range(480)]
    spark.createDataFrame(pitch, "recording_id string, channel string, t double, f0 double, intensity double").write.parquet(str(tmp_path / "f"))
    both = ["affect", "--faces", str(tmp_path / "s"), "--transcript", str(tmp_path / "in"), "--frames", str(tmp_path / "f"), "--named"]
    assert main([*both, "--out", str(tmp_path / "o3")]) == 0
    assert list((tmp_path / "o3" / "transcripts").glob("call-*-prosody.txt"))
    assert {p.name for p in (tmp_path / "o3" / "faces").glob("*-faces.txt")} == {f"{i}-faces.txt" for i in {r[0] for r in reports(tmp_path / "o")}}
    assert main(["affect", "--faces", str(tmp_path / "s"), "--transcript", str(tmp_path / "in"), "--out", str(tmp_path / "o4")]) == 2


def test_callcheck(spark, tmp_path, capsys):
    with wave.open(str(tmp_path / "call.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(8000)
        f.writeframes(struct.pack("<16000h", *([8000, 0] * 8000)))
    assert main(["callcheck", "--files", str(tmp_path)]) == 1
    assert "R: max -inf dB   mean -inf dB   -> DEAD" in capsys.readouterr().out
    assert main(["callcheck", "--files", str(tmp_path), "--fast"]) == 1


def test_small_sources(spark, tmp_path):
    rows = spark.createDataFrame([(1, "/a/b/x.mp3", 5), (61, "/a/bc/y.mp3", 1 << 31)], "frame_index long, path string, size long")
    assert [r[0] for r in rows.select(rd.frame_time(F.col("frame_index"), 2.0)).collect()] == [0.0, 30.0]
    assert [r["path"] for r in rd.under_root(rows, "/a/b/").collect()] == ["/a/b/x.mp3"]
    assert [tuple(r) for r in rows.select(lv.scan_mode(F.col("size")), lv.scan_mode(F.col("size"), "full")).collect()] == [("full", "full"), ("sampled", "full")]
    tags = spark.createDataFrame([(1.44, True), (-0.8, False), (0.2, True), (None, False)], "z double, nod boolean")
    assert [r[0] for r in tags.select(fc.tag(F.col("z"), F.col("nod"))).collect()] == ["{smile +1.4σ · nodding}", "{smile -0.8σ}", "{nodding}", ""]
    spans = spark.createDataFrame([("c", 1, 0.0, 2.5, "Dana", "Dana", 1.0, False), ("c", 2, 2.5, 4.0, None, "Gwen", 1.0, True)], "recording_id string, span_no long, start double, end double, name string, raw_ocr string, confidence double, unresolved boolean")
    tr.write_spans(spans, str(tmp_path / "spans"))
    assert sorted(map(str, tr.read_spans(spark, str(tmp_path / "spans")).collect())) == sorted(map(str, spans.collect()))
    for place in ("2024/audio_only", "2024/other", "deep/er/audio_only"):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / f"{len(place)}.mp3").write_bytes(b"x" * len(place))
    assert {r["recording_id"] for r in rd.recordings(spark, str(tmp_path)).collect()} == {"15", "18"}
    assert {(r["recording_id"], r["size"]) for r in rd.file_sizes(spark, str(tmp_path / "2024" / "other")).collect()} == {("10", 10)}
