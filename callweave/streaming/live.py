"""Live operators: rows that come late and out of order, recordings that end by falling silent.

Rows wait in keyed state until the watermark has passed them and are taken in their order then. An event-time timer wakes a
recording whose rows wait, and ends one that has had none for a while; no flag has to mark its last row. Each operator keeps one state
for a recording, as a watermark cannot be handed from one such operator to the next.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.stitch import TAIL, normal, overlap
from .jobs import settle

STATE = "times array<long>, orders array<double>, rows array<string>, own string, newest long, last double"


def in_order(rows: DataFrame, order: str, payload: list, out: str, step: Callable[[dict, list[dict], bool], list[tuple]], *, late: str, idle: str, ts: str = "ts") -> DataFrame:
    """(recording_id, ``out``): what ``step(own, taken, ended)`` returns over the rows of each recording.

    ``taken`` are rows (the ``payload`` columns) that the watermark has passed, by ``ts`` and ``order``; ``own`` is a dictionary of
    JSON values that is kept between calls. The watermark is ``late`` behind the newest row of all recordings. A row behind it
    when it comes is dropped, so is one without ``ts`` or ``order`` and one whose order is not above the last one taken. ``ended``
    is true once the watermark is ``idle`` past the newest row of the recording; its state is removed then, and later rows
    begin it anew. State: rows of the last stretch of ``late``, and ``own``.
    """
    key = rows.schema["recording_id"].dataType.simpleString()
    names = ["recording_id", *(part.split()[0] for part in out.split(", "))]
    pause = int(pd.Timedelta(idle) / pd.Timedelta(1, "ms"))
    timed = rows.filter(F.col(ts).isNotNull() & F.col(order).isNotNull()).withWatermark(ts, late)
    shaped = timed.select("recording_id", F.col(ts), F.unix_millis(ts).alias("at"), F.col(order).cast("double").alias("nth"), F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("body"))

    def one(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, own, newest, last = [], {}, -1, None
        if state.exists:
            *columns, own, newest, last = state.get
            waiting, own = list(zip(*columns, strict=True)), json.loads(own)
        for pdf in batches:
            waiting += zip(pdf["at"].tolist(), pdf["nth"].tolist(), pdf["body"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs()
        newest = max([newest, *(w[0] for w in waiting)])
        taken = []
        for _, nth, body in sorted(w for w in waiting if w[0] <= mark):
            if last is None or nth > last:
                taken.append(json.loads(body))
                last = nth
        waiting = [w for w in waiting if w[0] > mark]
        ended = not waiting and mark >= newest + pause
        found = step(own, taken, ended) if taken or ended else []
        if ended:
            state.remove()
        else:
            columns = [list(c) for c in zip(*waiting, strict=True)] if waiting else [[], [], []]
            state.update((*columns, json.dumps(own), newest, last))
            state.setTimeoutTimestamp(min((w[0] for w in waiting), default=newest + pause))
        yield pd.DataFrame([(name[0], *row) for row in found], columns=names)

    return shaped.groupBy("recording_id").applyInPandasWithState(one, f"recording_id {key}, {out}", STATE, "append", "EventTimeTimeout")


def _settled_lines(own: dict, taken: list[dict], ended: bool) -> list[tuple]:
    """(frame_no, lines): each frame when a later one or the end is known; the lowest of several lines only at the end."""
    frames = ([own.pop("held")] if "held" in own else []) + [[r["frame_no"], r.get("lines") or []] for r in taken]
    if ended:
        return [(n, lines if len(lines) <= 1 else lines[:-1]) for n, lines in frames[:-1]] + [tuple(f) for f in frames[-1:]]
    if frames:
        own["held"] = frames[-1]
    return [(n, lines if len(lines) <= 1 else lines[:-1]) for n, lines in frames[:-1]]


def settled_lines(frames: DataFrame, *, late: str = "10 seconds", idle: str = "1 minute") -> DataFrame:
    """(recording_id, frame_no, lines) of caption frames (recording_id, frame_no, ts, lines): without the line still under revision.

    The lowest line of a frame waits for a later frame to show it again, above another; a recording's last frame keeps it, once the
    timer has ended the recording.
    """
    return in_order(frames, "frame_no", ["frame_no", "lines"], "frame_no long, lines array<string>", _settled_lines, late=late, idle=idle)


def live_tokens(frames: DataFrame, *, tail: int = TAIL, late: str = "10 seconds", idle: str = "1 minute") -> DataFrame:
    """(recording_id, frame_no, marks, toks): what each frame adds to its recording, held-back lines and reordering included.

    ``frames``: recording_id, frame_no, ts, lines (tokens of each line: array<array<struct<is_spk, tok>>>). Joined by frame_no the
    tokens are those of ``rolling_merge`` over ``frame_tokens``; frames without lines or tokens are left out as there.
    """
    lines = F.transform("lines", lambda line: F.transform(line, lambda t: F.struct(t["is_spk"].alias("is_spk"), t["tok"].alias("tok"), normal(t).alias("key"))))

    def step(own: dict, taken: list[dict], ended: bool) -> list[tuple]:
        out = []
        for frame, shown in _settled_lines(own, taken, ended):
            tokens = [t for line in shown for t in line]
            keys, known = [t["key"] for t in tokens], own.get("keys", [])
            at = overlap(known, keys) if known else 0
            own["keys"] = [*known, *keys[at:]][-tail:]
            if tokens:
                out.append((frame, [t["is_spk"] for t in tokens[at:]], [t["tok"] for t in tokens[at:]]))
        return out

    shown = frames.filter(F.size("lines") > 0)
    return in_order(shown, "frame_no", ["frame_no", lines.alias("lines")], "frame_no long, marks array<boolean>, toks array<string>", step, late=late, idle=idle)


def live_spans(observations: DataFrame, *, fps: float = 2.0, debounce: float = 1.0, grace: float = 3.0, late: str = "10 seconds", idle: str = "1 minute") -> DataFrame:
    """(recording_id, start, end, name, raw_ocr, unresolved): the spans of ``timeline.spans`` as soon as no later frame can change them.

    ``observations``: recording_id, frame_index, ts, kind, who. A span is settled once two entries follow it in its
    timeline, or its recording has ended.
    """

    def step(own: dict, taken: list[dict], ended: bool) -> list[tuple]:
        runs = own.get("runs", [])
        for (kind, who), group in groupby(taken, lambda r: (r.get("kind"), r.get("who"))):
            frames = [r["frame_index"] for r in group]
            end = frames[-1] / fps + 1.0 / fps
            if runs and runs[-1][2:] == [kind, who]:
                runs[-1][1] = end
            else:
                runs.append([frames[0] / fps, end, kind, who])
        rows, own["runs"] = settle(runs, ended, debounce, grace)
        return rows

    out = "start double, end double, name string, raw_ocr string, unresolved boolean"
    return in_order(observations, "frame_index", ["frame_index", "kind", "who"], out, step, late=late, idle=idle)


def live_segments(frames: DataFrame, *, step: float, silence_bridge: float = 0.6, longest: float = 30.0, shortest: float = 0.8, late: str = "10 seconds", idle: str = "1 minute") -> DataFrame:
    """(recording_id, t_start, t_end) of voiced frames (recording_id, ts, t): the segments of ``vad_segments``, each when it is closed.

    A segment is closed by the first frame after a longer silence or after ``longest`` seconds, or by the end of its recording.
    """

    def close(own: dict, taken: list[dict], ended: bool) -> list[tuple]:
        times = np.array([r["t"] for r in taken], float)
        start, last, out = own.get("start"), own.get("last"), []
        silent = np.diff(times, prepend=times[:1] if last is None else last) > silence_bridge
        while len(times):
            start = times[0] if start is None else start
            ends = np.flatnonzero(silent | (times - start > longest))
            if not len(ends):
                last = times[-1]
                break
            k = ends[0]
            out.append((start, times[k - 1] if k else last))
            start, times, silent = times[k], times[k:], np.append(False, silent[k + 1 :])
        if ended and start is not None:
            out.append((start, last))
        own.update({} if start is None else {"start": float(start), "last": float(last)})
        return [(float(a), float(b) + step) for a, b in out if b - a >= shortest]

    return in_order(frames, "t", ["t"], "t_start double, t_end double", close, late=late, idle=idle)
