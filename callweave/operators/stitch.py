"""Stitching of rolling captions: overlap merge, stutter removal, turns.

Frames of a recording must be folded in order, and the alignment looks back over a bounded tail: chunks of frames are folded side
by side and joined where their states agree. All else is column expressions. Tokens are array<struct<is_spk, tok>>.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

ANCHOR = 4
TAIL = 400
TOKENS = "array<struct<is_spk:boolean,tok:string>>"


def normal(token: Column) -> Column:
    """Lower-case letters and digits of a token; a speaker mark stays as it is."""
    plain = F.regexp_replace(F.lower(token["tok"]), "[^a-z0-9]", "")
    return F.when(token["is_spk"], F.concat(F.lit("\u0001"), token["tok"])).otherwise(plain)


def frame_tokens(lines: DataFrame, speakers: DataFrame) -> DataFrame:
    """(recording_id, frame_no, tokens): speaker marks and words; the last line only where it will not change.

    The lowest line of a frame is still being revised and waits for a later frame, but for the last
    frame and for frames of one line. Frames without tokens are left out.
    """
    w = Window.partitionBy("recording_id", "frame_no")
    last = F.max("frame_no").over(Window.partitionBy("recording_id"))
    marked = lines.withColumns({"lines": F.count("*").over(w), "low": F.max("line_no").over(w), "final": last})
    kept = marked.filter((F.col("frame_no") == F.col("final")) | (F.col("lines") == 1) | (F.col("line_no") < F.col("low")))
    named = kept.join(speakers.select("text", "name"), "text", "left")
    words = F.transform(F.filter(F.split("text", r"\s+"), lambda x: x != ""), lambda x: F.struct(F.lit(False).alias("is_spk"), x.alias("tok")))
    toks = F.when(F.col("name").isNotNull(), F.array(F.struct(F.lit(True).alias("is_spk"), F.col("name").alias("tok")))).otherwise(words)
    listed = named.groupBy("recording_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("line_no", toks.alias("t")))).alias("all"))
    return listed.select("recording_id", "frame_no", F.flatten(F.transform("all", lambda x: x["t"])).alias("tokens")).filter(F.size("tokens") > 0)


def keys_of(tokens: Column) -> Column:
    return F.transform(tokens, normal)


def overlap(tail: list[str], frame: list[str], anchor: int = ANCHOR) -> int:
    """How many tokens of ``frame`` are known already: up to the block that reaches furthest into ``tail``.

    Mostly the frame begins with what the tail ends with. Where no other run of that length is common to
    both, it is the longest block there is and reaches furthest, so the alignment need not be made.
    """
    for k in range(min(len(tail), len(frame)), anchor - 1, -1):
        if tail[-k:] == frame[:k]:
            runs = {tuple(frame[i : i + k]) for i in range(len(frame) - k + 1)}
            same = sum(tuple(tail[i : i + k]) in runs for i in range(len(tail) - k + 1))
            if same == 1 and len(runs) == len(frame) - k + 1:
                return k
            break
    known, reach = 0, -1
    for block in SequenceMatcher(None, tail, frame, autojunk=False).get_matching_blocks():
        if block.size >= anchor and block.a + block.size > reach:
            reach, known = block.a + block.size, block.b + block.size
    return known


class Tail:
    """The keys that are merged already, and where each run of ``anchor`` of them stands: a frame is aligned by its own runs alone."""

    def __init__(self, keys: list[str], anchor: int, tail: int):
        self.keys, self.anchor, self.tail = [], anchor, tail
        self.places: dict[tuple, list[int]] = {}
        self.add(keys)

    def add(self, keys: list[str]) -> None:
        first = max(0, len(self.keys) - self.anchor + 1)
        self.keys += keys
        for i in range(first, len(self.keys) - self.anchor + 1):
            self.places.setdefault(tuple(self.keys[i : i + self.anchor]), []).append(i)

    def last(self) -> list[str]:
        return self.keys[-self.tail :]

    def overlap(self, frame: list[str]) -> int:
        """``overlap(self.last(), frame)``: the last matching block of ``anchor`` or more is found by taking the longest common run
        (of equals the first), then the longest one behind it in both, until none is long enough."""
        n, low = self.anchor, max(0, len(self.keys) - self.tail)
        runs, open_at = [], {}
        for j in range(len(frame) - n + 1):
            for i in reversed(self.places.get(tuple(frame[j : j + n]), ())):
                if i < low:
                    break
                run = open_at.get(i - j)
                if run and run[1] == j + n - 1:
                    run[1] = j + n
                else:
                    run = open_at[i - j] = [j, j + n, i - j]
                    runs.append(run)
        known = 0
        while True:
            begun = [(max(j, known, low - d), end, d) for j, end, d in runs]
            blocks = [(j - end, j + d, j, end, d) for j, end, d in begun if end - j >= n]
            if not blocks:
                return known
            *_, known, d = min(blocks)
            low = known + d


def _folded(batches, anchor: int, tail: int):
    """Chunks of sorted frames folded: from a given state (kind 0), or from what their frames of warming up (kind 1) come to."""
    at, state, begun, n, marks, toks, rows = None, None, None, 0, [], [], []
    types = {}

    def flushed():
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, list(types))

    for batch in batches:
        own = {f.name: f.type for f in batch.schema}
        types = {"recording_id": own["recording_id"], "chunk": pa.int64(), "n_frames": pa.int64(), "marks": own["marks"], "toks": own["toks"], "start": own["keys"], "end": own["keys"]}
        for rec, chunk, kind, m, t, k in zip(*(batch.column(c).to_pylist() for c in ("recording_id", "chunk", "kind", "marks", "toks", "keys")), strict=True):
            if at != (rec, chunk):
                if n:
                    rows.append((*at, n, marks, toks, begun, state.last()))
                at, state, begun, n, marks, toks = (rec, chunk), Tail(k if kind == 0 else [], anchor, tail), None, 0, [], []
            if kind == 0:
                continue
            if kind == 2:
                begun = state.last() if begun is None else begun
            new = state.overlap(k)
            state.add(k[new:])
            if kind == 2:
                n += 1
                marks += m[new:]
                toks += t[new:]
        if rows:
            yield flushed()
    if n:
        rows.append((*at, n, marks, toks, begun, state.last()))
        yield flushed()


def rolling_merge(frames: DataFrame, *, anchor: int = ANCHOR, tail: int = TAIL, chunk_frames: int = 1024, warm_frames: int = 96) -> DataFrame:
    """(recording_id, n_frames, tokens): the frames' tokens, each frame from where it goes on.

    The merge looks back over ``tail`` tokens only, so these are all its state. Stretches of ``chunk_frames`` frame numbers are folded
    by themselves, each after the last ``warm_frames`` of the one before, which mostly come to the state that the whole recording would
    have there. Where a chunk's first state is not the last one of the chunk before, it is folded again from that one, until all agree: the
    result is that of one fold over the recording, though no task ever holds more than a chunk. Chunks are sorted runs of rows, so a
    task takes many of them one after another. The merged tokens of a recording are one row.
    """
    key = frames.schema["recording_id"].dataType.simpleString()
    schema = f"recording_id {key}, chunk long, n_frames long, marks array<boolean>, toks array<string>, start array<string>, end array<string>"
    number = F.floor(F.col("frame_no") / chunk_frames).cast("long")
    here, ahead = F.struct(number.alias("chunk"), F.lit(2).alias("kind")), F.struct((number + 1).alias("chunk"), F.lit(1).alias("kind"))
    warms = F.pmod(F.col("frame_no"), F.lit(chunk_frames)) >= chunk_frames - warm_frames
    dealt = frames.select(
        "recording_id", "frame_no", F.col("tokens.is_spk").alias("marks"), F.col("tokens.tok").alias("toks"), keys_of(F.col("tokens")).alias("keys"),
        F.explode(F.when(warms, F.array(here, ahead)).otherwise(F.array(here))).alias("at"),
    ).select("recording_id", "at.chunk", "at.kind", "frame_no", "marks", "toks", "keys")

    def fold(rows):
        runs = rows.repartition("recording_id", "chunk").sortWithinPartitions("recording_id", "chunk", "kind", "frame_no")
        return written(runs.mapInArrow(lambda batches: _folded(batches, anchor, tail), schema))

    chunks = fold(dealt)
    before = F.coalesce(F.lag("end").over(Window.partitionBy("recording_id").orderBy("chunk")), F.array().cast("array<string>"))
    while True:
        linked = chunks.select("recording_id", "chunk", "start", "end").withColumn("before", before)
        wrong = written(linked.filter(F.col("start") != F.col("before")).select(F.col("recording_id").alias("rec"), F.col("chunk").alias("no"), "before"))
        if wrong.isEmpty():
            break
        meets = F.col("recording_id").eqNullSafe(F.col("rec")) & (F.col("chunk") == F.col("no"))
        nothing = [F.array().cast(t).alias(c) for t, c in (("array<boolean>", "marks"), ("array<string>", "toks"))]
        states = wrong.select(F.col("rec").alias("recording_id"), F.col("no").alias("chunk"), F.lit(0).alias("kind"), F.lit(None).cast(dealt.schema["frame_no"].dataType).alias("frame_no"), *nothing, F.col("before").alias("keys"))
        again = fold(dealt.filter("kind = 2").join(wrong.select("rec", "no"), meets, "left_semi").unionByName(states))
        chunks = written(chunks.join(wrong.select("rec", "no"), meets, "left_anti").unionByName(again))
    tokens = F.arrays_zip(F.col("marks").alias("is_spk"), F.col("toks").alias("tok")).cast(TOKENS)
    whole = chunks.groupBy("recording_id").agg(F.sum("n_frames").alias("n_frames"), F.array_sort(F.collect_list(F.struct("chunk", tokens.alias("tokens")))).alias("all"))
    return whole.select("recording_id", "n_frames", F.flatten(F.col("all.tokens")).alias("tokens"))


def from_first_speaker(tokens: Column) -> Column:
    """Tokens from the first speaker mark on; all of them without one."""
    at = F.array_position(F.transform(tokens, lambda t: t["is_spk"]), True)
    return F.when(at > 0, F.slice(tokens, at.cast("int"), F.size(tokens))).otherwise(tokens)


def cleaned(tokens: Column) -> Column:
    """A bar alone, or bars of a token that begins with bar and apostrophe, are the letter I."""
    word = lambda t: F.when(t == "|", "I").when(t.rlike(r"^\|['’].*$"), F.replace(t, F.lit("|"), F.lit("I"))).otherwise(t)
    return F.transform(tokens, lambda t: F.when(t["is_spk"], t).otherwise(F.struct(t["is_spk"].alias("is_spk"), word(t["tok"]).alias("tok"))))


def _said_again(codes: np.ndarray, n: int) -> np.ndarray:
    """Which tokens belong to copies, of ``n`` tokens, that are said again at once; codes below zero are empty words.

    A stretch of L tokens that each equal the one ``n`` places on holds L // n such copies, at its beginning.
    """
    same = np.zeros(len(codes), bool)
    if len(codes) > n:
        same[:-n] = (codes[:-n] == codes[n:]) & (codes[:-n] >= 0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same, [0]])))
    begins, lengths = edges[::2], edges[1::2] - edges[::2]
    out = np.zeros(len(codes) + 1, np.int64)
    np.add.at(out, begins, 1)
    np.add.at(out, begins + lengths // n * n, -1)
    return np.cumsum(out[:-1]) > 0


def kept_after_stutter(keys: list[str], longest: int = 8) -> list[int]:
    """Places left once phrases of up to ``longest`` words that are repeated at once are said only once, the last time."""
    number = {"": -1}
    return _kept_places(np.array([number.setdefault(k, len(number)) for k in keys], np.int64), longest).tolist()


def _kept_places(codes: np.ndarray, longest: int = 8) -> np.ndarray:
    places = np.arange(len(codes))
    before = -1
    while before != len(places):
        before = len(places)
        for n in range(longest, 0, -1):
            places = places[~_said_again(codes[places], n)]
    return places


PORTION = 200_000


def _flags(keys: pa.Array, portion: int = PORTION) -> pa.Array:
    """Which tokens stay, of many token lists: words as numbers that no two lists share, some ``portion`` of tokens (or one list) at a time."""
    ends = keys.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    values, flags, done = keys.flatten(), [], 0
    while done < len(ends):
        first = int(ends[done - 1]) if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, first + portion, "right")))
        words = values.slice(first, int(ends[upto - 1]) - first).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        silent = np.array([w == "" for w in words.dictionary.to_pylist()] + [False])[codes]
        row = np.repeat(np.arange(upto - done), np.diff(ends[done:upto], prepend=first))
        stays = np.zeros(len(codes), bool)
        stays[_kept_places(np.where(silent, -1, codes + row * (len(words.dictionary) + 1)))] = True
        flags.append(stays)
        done = upto
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flags) if flags else np.zeros(0, bool)))


@F.arrow_udf(T.ArrayType(T.BooleanType()))
def stutter_flags(keys: pa.Array) -> pa.Array:
    """Which tokens stay."""
    return _flags(keys)


def without_stutter(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``df`` with immediately repeated phrases of its tokens said once."""
    both = F.zip_with(F.col(tokens), F.col("__keep"), lambda t, k: F.struct(t.alias("t"), k.alias("k")))
    return df.withColumn("__keep", stutter_flags(keys_of(F.col(tokens)))).withColumn(tokens, F.transform(F.filter(both, lambda x: x["k"]), lambda x: x["t"])).drop("__keep")


def turns(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(recording_id, turn_no, speaker, text): words of a speaker up to the next other one."""
    rows = df.select("recording_id", F.posexplode(tokens).alias("pos", "t"))
    w = Window.partitionBy("recording_id").orderBy("pos")
    spoken = rows.withColumn("speaker", F.coalesce(F.last(F.when(F.col("t.is_spk"), F.col("t.tok")), True).over(w), F.lit("???"))).filter(~F.col("t.is_spk"))
    change = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w))
    numbered = spoken.withColumn("change", change.cast("long")).withColumn("turn_no", F.sum("change").over(w))
    grouped = numbered.groupBy("recording_id", "turn_no").agg(F.min("speaker").alias("speaker"), F.array_sort(F.collect_list(F.struct("pos", F.col("t.tok").alias("tok")))).alias("w"))
    return grouped.select("recording_id", "turn_no", "speaker", F.array_join(F.transform("w", lambda x: x["tok"]), " ").alias("text"))


def stitched(frames: DataFrame) -> DataFrame:
    """(recording_id, n_frames, tokens): merged, trimmed, cleaned and without stutter."""
    merged = rolling_merge(frames)
    return without_stutter(merged.withColumn("tokens", cleaned(from_first_speaker(F.col("tokens")))))


def stitched_texts(turn_rows: DataFrame, fixups: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(recording_id, text): ``speaker: text`` paragraphs, then the given substitutions in order."""
    line = F.concat(F.col("speaker"), F.lit(": "), F.col("text"))
    grouped = turn_rows.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("turn_no", line.alias("line")))).alias("all"))
    text = F.array_join(F.transform("all", lambda x: x["line"]), "\n\n")
    for pattern, new in fixups:
        text = F.regexp_replace(text, pattern, new)
    return grouped.select("recording_id", text.alias("text"))


def stitch_stats(done: DataFrame, turn_rows: DataFrame) -> DataFrame:
    """(recording_id, frames, tokens, turns); speaker marks count as tokens."""
    counted = turn_rows.groupBy("recording_id").agg(F.count("*").alias("turns"))
    joined = done.select("recording_id", F.col("n_frames").alias("frames"), F.size("tokens").cast("long").alias("tokens")).join(counted, "recording_id", "left")
    return joined.select("recording_id", "frames", "tokens", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"))
