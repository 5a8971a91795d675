"""Pitch and loudness frames of decoded sound, in numpy over Arrow batches: one row of samples in, many frames out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PITCH_FLOOR, PITCH_CEILING = 75.0, 500.0
SCHEMA = "recording_id string, channel int, t double, f0 double, intensity double"


def track(samples: np.ndarray, rate: int, *, step: float = 0.01, floor: float = PITCH_FLOOR, ceiling: float = PITCH_CEILING, voicing: float = 0.45) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(t, f0, intensity) of a channel: the best lag of the windowed autocorrelation, and decibels over 20 µPa.

    Windows hold three periods of the lowest pitch. f0 is NaN where no lag reaches ``voicing`` of the
    window's own correlation; a parabola through the best lag and its neighbours refines it.
    """
    size, hop = int(3 * rate / floor), max(1, int(step * rate))
    if len(samples) < size:
        return np.empty(0), np.empty(0), np.empty(0)
    starts = np.arange(0, len(samples) - size + 1, hop)
    low, high = int(rate / ceiling), min(int(rate / floor), size - 2)
    window = np.hanning(size)
    own = np.fft.irfft(np.abs(np.fft.rfft(window, 2 * size)) ** 2)[: high + 2]
    f0, loud = np.full(len(starts), np.nan), np.empty(len(starts))
    for i in range(0, len(starts), 2048):
        rows = samples[starts[i : i + 2048, None] + np.arange(size)]
        loud[i : i + 2048] = 10 * np.log10(np.maximum((rows**2).mean(axis=1), 1e-12) / 4e-10)
        rows = (rows - rows.mean(axis=1, keepdims=True)) * window
        corr = np.fft.irfft(np.abs(np.fft.rfft(rows, 2 * size, axis=1)) ** 2, axis=1)[:, : high + 2]
        corr = corr / np.maximum(corr[:, :1], 1e-12) / (own / own[0])
        # of nearly equal peaks the shortest lag is the period
        best = np.argmax(corr[:, low : high + 1] - 0.02 * np.log2(np.arange(low, high + 1) / low), axis=1) + low
        at = np.arange(len(rows))
        a, b, c = corr[at, best - 1], corr[at, best], corr[at, best + 1]
        bend = a - 2 * b + c
        shift = np.where(np.abs(bend) > 1e-12, 0.5 * (a - c) / np.where(bend == 0, 1, bend), 0.0)
        good = (b >= voicing) & (rows.std(axis=1) > 1e-4)
        f0[i : i + 2048] = np.where(good, rate / (best + np.clip(shift, -1, 1)), np.nan)
    return (starts + size / 2) / rate, f0, loud


def pitch_frames(channels: DataFrame, *, step: float = 0.01) -> DataFrame:
    """Frames (recording_id, channel, t, f0, intensity) of channels (recording_id, channel, rate, samples)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, channel, rate, samples in zip(batch["recording_id"], batch["channel"], batch["rate"], batch["samples"], strict=True):
                t, f0, loud = track(np.asarray(samples, float), int(rate), step=step)
                yield pd.DataFrame({"recording_id": name, "channel": channel, "t": t, "f0": [None if np.isnan(x) else float(x) for x in f0], "intensity": loud})

    return channels.select("recording_id", "channel", "rate", "samples").mapInPandas(run, SCHEMA)


def tile_pixels(frames: DataFrame) -> DataFrame:
    """Gray pixels (recording_id, frame_index, x, y, gray) of decoded frames (width, gray: array of bytes)."""
    from pyspark.sql import functions as F

    rows = frames.select("recording_id", "frame_index", "width", F.posexplode("gray").alias("i", "gray"))
    return rows.select("recording_id", "frame_index", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), "gray")
