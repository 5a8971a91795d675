"""Recordings longer than a task should hold: chunked caption merge, lines and spans by stretches, sound by byte ranges."""

import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.cli import main
from callweave.operators import attribution as att
from callweave.operators import levels as lv
from callweave.operators import stitch as st
from callweave.plans import capture
from callweave.sources import fixtures as fx
from callweave.sources import wav

SF = "/root/testdata/sf0.001"
FRAMES = "recording_id string, frame_no long, tokens array<struct<is_spk:boolean,tok:string>>"


def plain_fold(frames, anchor=4, tail=400):
    keys, out = [], []
    for tokens in frames:
        own = [f"\1{t}" if s else "".join(c for c in t.lower() if c.isascii() and c.isalnum()) for s, t in tokens]
        at = st.overlap(keys[-tail:], own, anchor) if keys else 0
        keys += own[at:]
        out += tokens[at:]
    return out


def revised_frames(rng, n, words):
    """Windows over a text whose words are read wrongly, cut short or corrected from frame to frame; some frames show something else."""
    text = [(rng.random() < 0.03, rng.choice(words)) for _ in range(5 * n + 30)]
    out = []
    for i in range(n):
        part = list(text[5 * i : 5 * i + rng.choice((12, 20, 25))])
        for k in range(len(part)):
            if rng.random() < 0.04:
                part[k] = (False, rng.choice(words))
        if part and rng.random() < 0.5:
            part[-1] = (part[-1][0], part[-1][1][:2])
        if rng.random() < 0.05:
            part = [(False, rng.choice(words)) for _ in range(rng.randrange(0, 9))]
        out.append(part)
    return out


@pytest.mark.parametrize(("chunk", "warm", "tail", "vocabulary"), [(1024, 96, 400, 300), (16, 4, 400, 300), (7, 0, 60, 40), (5, 2, 400, 6)])
def test_chunked_merge_is_the_fold(spark, chunk, warm, tail, vocabulary):
    rng = random.Random(chunk)
    words = [f"w{i}" for i in range(vocabulary)] + ["|'m", "...", "é"]
    calls = {name: revised_frames(rng, n, words) for name, n in (("a", 60), ("b", 1), ("c", 37))} | {None: revised_frames(rng, 20, words)}
    rows = [(name, 3 * i if name == "c" else i, tokens) for name, frames in calls.items() for i, tokens in enumerate(frames)]
    rng.shuffle(rows)
    merged = st.rolling_merge(spark.createDataFrame(rows, FRAMES), chunk_frames=chunk, warm_frames=warm, tail=tail)
    found = {r["recording_id"]: (r["n_frames"], [tuple(t) for t in r["tokens"]]) for r in merged.collect()}
    assert found == {name: (len(frames), plain_fold(frames, tail=tail)) for name, frames in calls.items()}
    assert st.rolling_merge(spark.createDataFrame([], FRAMES)).collect() == []


def test_revised_frames_of_the_query(spark):
    frames = {}
    for r in fx.revised_windows(spark, SF).collect():
        frames.setdefault(r["recording_id"], {})[r["frame_no"]] = [tuple(t) for t in r["tokens"]]
    found = {r["recording_id"]: (r["n_frames"], r["n"], r["text"]) for r in capture.revised_merge(spark, SF).collect()}
    whole = {r: plain_fold([f[i] for i in sorted(f)]) for r, f in frames.items()}
    assert found == {r: (len(frames[r]), len(t), " ".join(x for _, x in t)) for r, t in whole.items()}
    assert max(map(len, frames.values())) > 64


def test_first_span_that_holds_a_line(spark):
    rng = random.Random(4)
    names = ["Ann", "Bob", "You", "", None]
    spans = [(r, i, s := rng.uniform(-50, 400), s + rng.choice((-1.0, 0.0, 0.5, 5.0, 200.0, float("inf"))), rng.choice(names)) for r in ("x", "y") for i in range(60)]
    lines = [(r, i, rng.uniform(0, 420), rng.choice(("Caller", "You")), "t") for r in ("x", "y", "z") for i in range(200)] + [("x", 900, None, "Caller", "t")]
    found = att.relabel_timed(spark.createDataFrame(lines, "recording_id string, line_no long, t double, label string, text string"), spark.createDataFrame(spans, "recording_id string, span_no long, start double, end double, name string"))

    def label(r, t, own):
        first = next((n for q, _, s, e, n in spans if q == r and t is not None and s <= t - 1.5 < e), None)
        return first if own == "Caller" and first and first != "You" else own

    assert {(r["recording_id"], r["line_no"]): r["label"] for r in found.collect()} == {(r, i): label(r, t, own) for r, i, t, own, _ in lines}


def test_a_hundred_thousand_lines_and_spans_of_one_recording(spark):
    n = 100_000
    lines = spark.range(n).select(F.lit("r").alias("recording_id"), F.col("id").alias("line_no"), (F.col("id") * 0.9 + 1.5).alias("t"), F.lit("Caller").alias("label"), F.lit("t").alias("text"))
    spans = spark.range(n).select(F.lit("r").alias("recording_id"), F.col("id").alias("span_no"), F.col("id").cast("double").alias("start"), (F.col("id") + 0.5).alias("end"), F.format_string("p%d", "id").alias("name"))
    at = F.col("line_no") * 0.9
    wanted = F.when(at - F.floor(at) < 0.5, F.format_string("p%d", F.floor(at))).otherwise("Caller")
    found = att.relabel_timed(lines, spans)
    assert found.count() == n and found.filter((F.col("label") != wanted) & (F.abs(at - F.floor(at) - 0.5) > 1e-6) & (F.abs(at - F.round(at)) > 1e-6)).count() == 0


# ---------------------------------------------------------------- sound


def written_wav(path, data, rate=8000):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(data.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(data.astype("<i2").tobytes())


def test_headers_of_all_kinds(spark, tmp_path):
    data = np.arange(40).reshape(-1, 2)
    written_wav(tmp_path / "good.wav", data)
    whole = (tmp_path / "good.wav").read_bytes()
    fmt = whole[12:36]
    body = struct.pack("<4sI", b"LIST", 3) + b"abc\0" + fmt + struct.pack("<4sI", b"data", 80) + whole[44:]
    (tmp_path / "list.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    (tmp_path / "stream.wav").write_bytes(whole[:40] + struct.pack("<I", 0xFFFFFFFF) + whole[44:])
    (tmp_path / "cut.wav").write_bytes(whole[:-8])
    (tmp_path / "short.wav").write_bytes(b"RIFF")
    (tmp_path / "other.wav").write_bytes(b"RIFF\0\0\0\0WAVEjunk" + b"\0" * 20)
    found = {r["recording_id"]: r for r in wav.headers(spark, str(tmp_path)).collect()}
    assert {k: (r["frames"], r["rate"], r["channels"], r["duration"]) for k, r in found.items()} == {
        "good": (20, 8000, 2, 0.0025), "list": (20, 8000, 2, 0.0025), "stream": (20, 8000, 2, 0.0025), "cut": (18, 8000, 2, 0.00225), "short": (None,) * 4, "other": (None,) * 4,
    }
    parts = wav.samples(lv.stretches(wav.headers(spark, str(tmp_path))), block=7).collect()
    for name in ("good", "list", "stream"):
        for c in (0, 1):
            mine = sorted((r["begin"], r["samples"]) for r in parts if r["recording_id"] == name and r["channel"] == c)
            assert [round(x * 32768) for _, s in mine for x in s] == data[:, c].tolist() and [b for b, _ in mine] == [0, 7, 14]
    assert {r["recording_id"] for r in parts} == {"good", "list", "stream", "cut"}


def test_a_file_of_three_gigabytes_is_sampled(spark, tmp_path, capsys):
    rate, size = 48_000, 3_000_000_000
    path = tmp_path / "long.wav"
    head = b"RIFF" + struct.pack("<I", size + 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, rate, rate * 4, 4, 16) + b"data" + struct.pack("<I", size)
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(44 + size)
        duration = size // (4 * rate)
        f.seek(44 + 4 * rate * (int(duration * 0.5) + 3))
        f.write(np.tile(np.array([8000, 0], "<i2"), rate).tobytes())  # a second of sound on the left, in the third window
    headers = wav.headers(spark, str(tmp_path))
    assert headers.first()["duration"] == size // 4 / rate
    stretches = lv.stretches(headers)
    assert [r["mode"] for r in stretches.collect()] == ["sampled"] * 5
    energy = wav.energy(stretches)
    assert energy.agg(F.sum("bytes_read")).first()[0] == 2 * 5 * 12 * rate * 2
    levels = {r["channel"]: (round(r["mean_db"], 2), round(r["max_db"], 2)) for r in lv.levels_of_energy(energy).collect()}
    power = (8000 / 32768) ** 2
    assert levels == {0: (round(10 * np.log10(power / 12), 2), round(10 * np.log10(power), 2)), 1: (-91.0, -91.0)}
    assert main(["callcheck", "--files", str(tmp_path)]) == 1
    assert "long L: max -12.2 dB   mean -23.0 dB   -> OK" in capsys.readouterr().out


def test_levels_of_ranges_are_those_of_the_samples(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = (rng.standard_normal((8000 * 60, 2)) * np.linspace(10, 9000, 8000 * 60)[:, None]).clip(-32768, 32767)
    data[:, 1] = 0
    written_wav(tmp_path / "minute.wav", data)
    headers = wav.headers(spark, str(tmp_path))
    x = data.astype("<i2") / 32768
    for forced, windows in (("full", [x]), ("sampled", [x[8000 * s : 8000 * (s + 12)] for s in (6, 18, 30, 42, 54)])):
        got = {r["channel"]: (r["mean_db"], r["max_db"]) for r in lv.levels_of_energy(wav.energy(lv.stretches(headers, forced), block=5000)).collect()}
        mean, peak = max(10 * np.log10((w[:, 0] ** 2).mean()) for w in windows), max(20 * np.log10(np.abs(w[:, 0]).max()) for w in windows)
        assert np.allclose(got[0], (mean, peak), atol=1e-9)
        assert got[1] == ((float("-inf"),) * 2 if forced == "full" else (-91.0, -91.0))


def test_runs_find_the_block_that_alignment_finds():
    rng = random.Random(3)
    for _ in range(3000):
        words = [f"w{i}" for i in range(rng.choice((1, 2, 3, 6, 20)))]
        anchor, tail = rng.choice((1, 2, 3, 4)), rng.choice((5, 20, 40, 400))
        keys, frame = ([rng.choice(words) for _ in range(rng.randrange(n))] for n in (70, 25))
        state = st.Tail(keys[:10], anchor, tail)
        state.add(keys[10:])
        assert state.overlap(frame) == (st.overlap(keys[-tail:], frame, anchor) if keys else 0), (keys, frame, anchor, tail)


@pytest.mark.parametrize("portion", [1, 10, 1000])
def test_stutter_of_many_recordings_in_portions(portion):
    import pyarrow as pa

    rng = random.Random(portion)
    for _ in range(100):
        rows = [None if rng.random() < 0.05 else [rng.choice(("a", "b", "c", "", "d")) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(12))]
        found = st._flags(pa.array([["zz"], *rows], pa.list_(pa.string())).slice(1), portion).to_pylist()
        assert found == [[i in set(st.kept_after_stutter(r or [])) for i in range(len(r or []))] for r in rows]
