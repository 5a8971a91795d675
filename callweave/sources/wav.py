"""WAV files by byte ranges: only what is asked for is read, however large a file is.

Files are listed by Spark, their headers are read chunk by chunk in the tasks, and stretches of frames are read a block at a time by seeking. Paths are
those of Spark; local ones and those of the file systems that Arrow opens (object stores, HDFS) can be read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import stem

#: Frames that a block has at most.
BLOCK = 1 << 18
HEADER = "channels int, rate int, bits int, data_at long, frames long, duration double"


def _opened(path: str):
    """A seekable file."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        system, place = fs.FileSystem.from_uri(path)
    else:
        system, place = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    return system.open_input_file(place)


def parsed_header(file, length: int) -> tuple[int, int, int, int, int, float] | None:
    """The values of ``HEADER`` of a PCM file, or None. A size that is zero or too large (cut or streamed files, RF64) means up to the end."""
    head = file.read(12)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        return None
    kind, at = None, 12
    while at + 8 <= length:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        at += 8
        if name == b"fmt " and size >= 16:
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            kind = (channels, rate, bits) if code in (1, 0xFFFE) and channels and rate and bits else None
        elif name == b"data":
            if kind is None:
                return None
            size = min(size, length - at) if size else length - at
            frames = size // (kind[0] * kind[2] // 8)
            return (*kind, at, frames, frames / kind[1])
        at += size + size % 2
    return None


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, path, bytes, channels, rate, bits, data_at, frames, duration) of WAV files; no sample is read.

    Other files have nulls; files without a byte are not listed by Spark.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    listed = files.select(stem(F.col("path")).alias("recording_id"), "path", F.col("length").alias("bytes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = []
            for place, length in zip(pdf["path"], pdf["bytes"], strict=True):
                with _opened(place) as file:
                    found.append(parsed_header(file, int(length)) or (None,) * 6)
            made = pd.DataFrame(found, columns=[c.split()[0] for c in HEADER.split(", ")], index=pdf.index)
            yield pd.concat([pdf, made.astype({c: "Int64" for c in made.columns[:-1]})], axis=1)

    return listed.mapInPandas(run, f"recording_id string, path string, bytes long, {HEADER}")


def _blocks(stretches: DataFrame, block: int) -> DataFrame:
    """Stretches (``first``, ``count`` of frames) cut into blocks, dealt over the tasks; only files of 16 bits have any."""
    some = stretches.filter("bits = 16 and count > 0")
    cut = some.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(block).cast("long"))))
    cut = cut.withColumns({"at": F.col("first") + F.col("begin"), "size": F.least(F.lit(block).cast("long"), F.col("count") - F.col("begin"))})
    return cut.repartition("path", "at")


def _read(path: str, channels: int, data_at: int, at: int, size: int) -> np.ndarray:
    """(frames, channels) between -1 and 1."""
    with _opened(path) as file:
        file.seek(data_at + 2 * channels * at)
        raw = file.read(2 * channels * size)
    return np.frombuffer(raw[: len(raw) // (2 * channels) * 2 * channels], "<i2").reshape(-1, channels) / 32768.0


def energy(stretches: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(recording_id, channel, stretch, whole, samples, energy, peak, bytes_read) of the blocks of stretches; samples do not leave their task."""
    columns = ["recording_id", "path", "channels", "data_at", "at", "size", "stretch", "whole"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, path, channels, data_at, at, size, stretch, whole in pdf[columns].itertuples(index=False):
                x = _read(path, channels, data_at, at, size)
                rows += [(name, c, stretch, whole, len(x), float(x[:, c] @ x[:, c]), float(np.abs(x[:, c]).max(initial=0.0)), 2 * len(x)) for c in range(channels)]
            yield pd.DataFrame(rows, columns=["recording_id", "channel", "stretch", "whole", "samples", "energy", "peak", "bytes_read"])

    return _blocks(stretches, block).select(*columns).mapInPandas(run, "recording_id string, channel int, stretch int, whole boolean, samples long, energy double, peak double, bytes_read long")


def samples(stretches: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(recording_id, channel, rate, stretch, begin, samples): each channel by itself, a row for each block; ``begin`` is its first frame in the file."""
    columns = ["recording_id", "path", "channels", "rate", "data_at", "at", "size", "stretch"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, path, channels, rate, data_at, at, size, stretch in pdf[columns].itertuples(index=False):
                x = _read(path, channels, data_at, at, size)
                for c in range(channels):
                    yield pd.DataFrame({"recording_id": [name], "channel": [c], "rate": [rate], "stretch": [stretch], "begin": [at], "samples": [x[:, c]]})

    return _blocks(stretches, block).select(*columns).mapInPandas(run, "recording_id string, channel int, rate int, stretch int, begin long, samples array<double>")
