import numpy as np

from callweave.operators import audio
from callweave.operators import captions as cp
from callweave.operators import prosody as pr

RATE = 16000


def glide(start, end, seconds=1.6):
    t = np.arange(int(RATE * seconds)) / RATE
    phase = 2 * np.pi * np.cumsum(start + (end - start) * t / seconds) / RATE
    return sum(np.sin(k * phase) / k for k in (1, 2, 3)) * 0.2


def test_track_of_a_tone():
    t, f0, loud = audio.track(glide(200, 200), RATE)
    assert abs(np.nanmedian(f0) - 200) < 1 and np.isnan(f0).mean() < 0.05
    assert np.isnan(audio.track(np.zeros(RATE), RATE)[1]).all() and len(audio.track(np.zeros(10), RATE)[0]) == 0
    assert loud.mean() > audio.track(glide(200, 200) * 0.1, RATE)[2].mean() + 19


def test_delivery_from_sound(spark):
    """Rising and falling glides, one of them loud, to slopes and scores."""
    quiet, parts = np.zeros(RATE // 2), []
    for start, end, gain in ((150, 260, 1.0), (260, 150, 1.0), (180, 185, 1.0), (200, 205, 4.0)):
        parts += [glide(start, end) * gain, quiet]
    sound = np.concatenate(parts)
    channels = spark.createDataFrame([("call", 1, RATE, sound.tolist())], "recording_id string, channel int, rate int, samples array<double>")
    frames = audio.pitch_frames(channels)
    utts = spark.createDataFrame([("call", 1, i, 2.1 * i, 2.1 * i + 1.6) for i in range(4)], "recording_id string, channel int, utt long, t_start double, t_end double")
    own = pr.frames_of(utts, frames).cache()
    keys = ["recording_id", "utt"]
    slopes = {r["utt"]: r["f0_slope"] for r in pr.terminal_slope(own, keys).collect()}
    assert slopes[0] > 30 and slopes[1] < -30 and abs(slopes[2]) < 20
    rows = pr.voiced_energy(own, keys).selectExpr("*", "1.6D as duration")
    scores = {r["utt"]: r["z_energy"] for r in pr.zscores(rows, ["recording_id"], names=("energy",)).collect()}
    assert scores[3] > 1.5 and max(scores[i] for i in range(3)) < 0


def test_dark_band(spark):
    frames = spark.createDataFrame([("r", 1, 2, [10, 200, 20, 30]), ("r", 2, 2, [200, 200, 200, 10])], "recording_id string, frame_index long, width int, gray array<int>")
    pixels = audio.tile_pixels(frames)
    assert {r["frame_index"]: r["band_present"] for r in cp.band_present(pixels).collect()} == {1: True, 2: False}
    assert cp.crop(pixels, (0, 1, 2, 1)).count() == 4
