"""Structured Streaming forms of the operators whose inputs arrive while a call goes on.

They extend the batch library: bins with a watermark, voiced segments as sessions, and the caption merge
with a bounded tail of state for each recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.stitch import TAIL, keys_of, overlap


def smile_bins(samples: DataFrame, *, seconds: int = 30, least: int = 20, late: str = "1 minute") -> DataFrame:
    """(recording_id, start, n, mean_smile) of samples (recording_id, ts, smile): tumbling windows with late data."""
    seen = samples.filter("smile is not null").withWatermark("ts", late)
    bins = seen.groupBy("recording_id", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.avg("smile").alias("mean_smile"))
    return bins.filter(F.col("n") >= least).select("recording_id", F.col("w.start").alias("start"), "n", "mean_smile")


def voiced_sessions(frames: DataFrame, *, silence: str = "600 milliseconds", shortest: float = 0.8, late: str = "10 seconds") -> DataFrame:
    """(recording_id, start, end) of voiced frames (recording_id, ts), cut at silences."""
    sessions = frames.withWatermark("ts", late).groupBy("recording_id", F.session_window("ts", silence).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return sessions.filter(F.col("end").cast("double") - F.col("start").cast("double") >= F.lit(float(shortest))).select("recording_id", "start", "end")


def held_back(frames: DataFrame) -> DataFrame:
    """Caption frames (recording_id, frame_no, lines, final) without the line that is still being revised.

    The lowest line waits for a later frame to show it again, above another; frames of one line and a recording's
    final frame keep it.
    """
    settled = F.when(F.col("final") | (F.size("lines") <= 1), F.col("lines")).otherwise(F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0))))
    return frames.withColumn("lines", settled)


def committed_tokens(frames: DataFrame, *, tail: int = TAIL) -> DataFrame:
    """(recording_id, frame_no, marks, toks): what each caption frame adds to its recording.

    The state of a recording is the last ``tail`` token keys and the last frame number; frames of one
    micro-batch are taken in order, and a frame that comes after a later one is left out.
    """
    key = frames.schema["recording_id"].dataType.simpleString()
    shaped = frames.select("recording_id", "frame_no", F.col("tokens.is_spk").alias("marks"), F.col("tokens.tok").alias("toks"), keys_of(F.col("tokens")).alias("keys"))

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, last = (list(state.get[0]), state.get[1]) if state.exists else ([], -1)
        rows = []
        for pdf in [pd.concat(list(batches)).sort_values("frame_no")]:
            for frame, marks, toks, keys in zip(pdf["frame_no"], pdf["marks"], pdf["toks"], pdf["keys"], strict=True):
                if frame <= last:
                    continue
                at = overlap(known, list(keys)) if known else 0
                rows.append((name[0], frame, list(marks[at:]), list(toks[at:])))
                known, last = [*known, *keys[at:]][-tail:], int(frame)
        state.update((known, last))
        yield pd.DataFrame(rows, columns=["recording_id", "frame_no", "marks", "toks"])

    return shaped.groupBy("recording_id").applyInPandasWithState(
        step, f"recording_id {key}, frame_no long, marks array<boolean>, toks array<string>", "known array<string>, last long", "append", "NoTimeout"
    )


def new_files(spark: SparkSession, folder: str, schema: str, *, per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they arrive; with a checkpoint each is taken once, which is the skip of finished work."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def _joined(runs: pd.DataFrame, begins: pd.Series) -> pd.DataFrame:
    """Runs joined to the last one that begins an entry, whose key and place are kept."""
    first = begins.to_numpy(bool)
    first[:1] = True
    return runs[first].assign(end=runs["end"].to_numpy()[np.append(first[1:], True)[: len(runs)]]).reset_index(drop=True)


def _timeline(runs: list[list], debounce: float, grace: float) -> pd.DataFrame:
    """Raw runs (start, end, kind, who) to entries (start, end, kind, who, place of the first raw run), gaps included.

    The closed form of ``operators.timeline`` over the few runs that are not settled.
    """
    t = pd.DataFrame(runs, columns=["start", "end", "kind", "who"]).astype({"kind": object, "who": object})
    t["place"] = range(len(t))
    before = t["kind"].shift()
    t = _joined(t, ~((t["kind"] != "gap") & (t["end"] - t["start"] < debounce) & before.notna() & (before != "gap")))
    key = t["kind"] + "\0" + t["who"].fillna("\0")
    t = _joined(t, key != key.shift())
    around = (t["kind"].shift() == "name") & (t["kind"].shift(-1) == "name") & (t["who"].shift() == t["who"].shift(-1))
    absorbed = (t["kind"] == "gap") & (t["end"] - t["start"] < grace) & around
    return _joined(t, ~absorbed & ~absorbed.shift(fill_value=False))


def settle(runs: list[list], ended: bool, debounce: float, grace: float) -> tuple[list[tuple], list[list]]:
    """Rows (start, end, name, raw_ocr, unresolved) of the spans that no later frame can change, and the raw runs after them."""
    entries = _timeline(runs, debounce, grace)
    ready = len(entries) if ended else max(0, len(entries) - 2)
    done = entries[:ready]
    rows = [(round(s, 3), round(e, 3), who if kind == "name" else None, who, kind != "name") for s, e, kind, who in zip(done["start"], done["end"], done["kind"], done["who"], strict=True) if kind != "gap"]
    return rows, [] if ended else runs[entries["place"][ready] :] if ready else runs


def settled_spans(observations: DataFrame, *, fps: float = 2.0, debounce: float = 1.0, grace: float = 3.0) -> DataFrame:
    """(recording_id, start, end, name, raw_ocr, unresolved): spans as soon as no later frame can change them.

    ``observations``: recording_id, frame_index, kind, who, final (true in a recording's last frame). A span is
    settled once two entries follow it in its timeline, and when the recording ends; the state is the raw
    runs after the last settled span. Frames must come in order; older ones are left out.
    """
    key = observations.schema["recording_id"].dataType.simpleString()

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, last = ([list(r) for r in zip(*state.get[:4], strict=True)], state.get[4]) if state.exists else ([], -1)
        ended = False
        for frame, kind, who, final in pd.concat(list(batches)).sort_values("frame_index")[["frame_index", "kind", "who", "final"]].itertuples(index=False):
            if frame <= last:
                continue
            who, t, last, ended = None if pd.isna(who) else who, frame / fps, int(frame), ended or bool(final)
            if runs and runs[-1][2:] == [kind, who]:
                runs[-1][1] = t + 1 / fps
            else:
                runs.append([t, t + 1 / fps, kind, who])
        found, runs = settle(runs, ended, debounce, grace)
        rows = [(name[0], *row) for row in found]
        if ended:
            state.remove()
        else:
            columns = [list(c) for c in zip(*runs, strict=True)] if runs else [[], [], [], []]
            state.update((*columns, last))
        yield pd.DataFrame(rows, columns=["recording_id", "start", "end", "name", "raw_ocr", "unresolved"])

    return observations.select("recording_id", "frame_index", "kind", "who", "final").groupBy("recording_id").applyInPandasWithState(
        step, f"recording_id {key}, start double, end double, name string, raw_ocr string, unresolved boolean",
        "starts array<double>, ends array<double>, kinds array<string>, whos array<string>, last long", "append", "NoTimeout",
    )
