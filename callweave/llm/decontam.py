"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

A benchmark item's windows are all its runs of ``window`` words; an item of fewer words, but not none,
is one window. Document words are scanned as rolling window hashes against the sorted hashes; each
candidate is then verified by its words, so a hash collision is never a hit. Words inside any
occurrence of a window are hit. The broadcast is bounded by ``block_bytes`` of benchmark text: a larger
benchmark is cut into blocks of items, each written as a flat file that ``addFile`` hands to every executor, where
workers memory-map it. Documents are read once whatever the size of the benchmark, and nothing is shuffled.

Nulls: a null text has no words and no hits; a null benchmark text has no windows; items with a null id
mark words but are not listed. Repeated items and documents are each treated on their own. Texts of any length are
read whole. Columns named as a result are replaced; empty tables give no rows, or no hits.
"""

from __future__ import annotations

import functools
import math
import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import absent, append_columns
from .textnp import Words

SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@dataclass(frozen=True)
class Windows:
    """The windows of a block of items, in arrays: about ten bytes for each byte of its text.

    ``tables``: length -> (known, bounds, at); windows of hash ``known[i]`` begin at the words
    ``at[bounds[i]:bounds[i + 1]]`` of ``words``.
    """

    words: Words
    items: list
    tables: dict

    def owners(self, length: int, place: int, text: bytes) -> list | None:
        """Sorted ids of the items with exactly this window; None if there is none."""
        _, bounds, at = self.tables[length]
        rows = [self.words.doc[i] for i in at[bounds[place] : bounds[place + 1]] if self.words.text(i, length) == text]
        return sorted({self.items[r] for r in rows if self.items[r] is not None}) if rows else None


def _windows(items: list[tuple[str | None, str]], window: int) -> Windows:
    words = Words(pa.array([text for _, text in items], pa.string()))
    lengths = np.minimum(np.diff(words.first), window)
    tables = {}
    for length in np.unique(lengths[lengths > 0]).tolist():
        at, hashes = words.windows(length)
        own = lengths[words.doc[at]] == length
        at, hashes = at[own], hashes[own]
        order = np.argsort(hashes, kind="stable")
        known, first = np.unique(hashes[order], return_index=True)
        tables[length] = (known, np.append(first, len(order)), at[order])
    return Windows(words, [item for item, _ in items], tables)


def _save(windows: Windows, path: str) -> list[tuple[str, str, int]]:
    """Writes the arrays of a block one after the other; returns their names, types and lengths."""
    ids = [b"" if i is None else b"=" + i.encode() for i in windows.items]
    arrays = {"bytes": windows.words.bytes, "start": windows.words.start, "end": windows.words.end, "doc": windows.words.doc}
    arrays |= {"ids": np.frombuffer(b"".join(ids), np.uint8), "ends": np.cumsum([len(i) for i in ids], dtype=np.int64)}
    for length, parts in windows.tables.items():
        arrays |= {f"{name} {length}": part for name, part in zip(("known", "bounds", "at"), parts, strict=True)}
    with open(path, "wb") as f:
        for array in arrays.values():
            f.write(np.ascontiguousarray(array).tobytes())
            f.write(bytes(-f.tell() % 8))
    return [(name, array.dtype.str, len(array)) for name, array in arrays.items()]


@functools.lru_cache(maxsize=256)
def _opened(name: str, layout: tuple) -> Windows:
    """A block in the memory-mapped file, kept by a worker between tasks."""
    data, at, arrays = np.memmap(SparkFiles.get(name), np.uint8, "r"), 0, {}
    for key, kind, n in layout:
        size = n * np.dtype(kind).itemsize
        arrays[key] = data[at : at + size].view(kind)
        at += size + -size % 8
    words = Words.__new__(Words)
    words.bytes, words.start, words.end, words.doc = (arrays[k] for k in ("bytes", "start", "end", "doc"))
    edges = [0, *arrays["ends"].tolist()]
    ids = [bytes(arrays["ids"][a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    lengths = sorted({int(k.split()[1]) for k in arrays if k.startswith("known ")})
    return Windows(words, [i[1:].decode() if i else None for i in ids], {n: tuple(arrays[f"{k} {n}"] for k in ("known", "bounds", "at")) for n in lengths})


#: Windows whose owners a task remembers.
REMEMBERED = 200_000


def _scan(blocks):
    """``blocks`` gives the blocks of the benchmark within a task."""

    def make():
        benchmark = blocks()
        met: dict[tuple[int, int, bytes], list | None] = {}

        def function(texts):
            words = Words(texts)
            hits: dict[int, list] = {}
            if len(met) > REMEMBERED:
                met.clear()
            for number, block in enumerate(benchmark):
                for length, (known, _, _) in block.tables.items():
                    at, hashes = words.windows(length)
                    if not len(at):
                        continue
                    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    for i in np.flatnonzero(known[place] == hashes):
                        begin = int(at[i])
                        key = number, length, words.text(begin, length)
                        if key not in met:
                            met[key] = block.owners(length, place[i], key[2])
                        if met[key] is not None:
                            hits.setdefault(int(words.doc[begin]), []).append((begin, begin + length, met[key]))
            spans: list[list] = [[] for _ in range(len(texts))]
            ids: list[list] = [[] for _ in range(len(texts))]
            for row, more in hits.items():
                zero = int(words.first[row])
                merged: list[list[int]] = []
                for b, e in sorted((b - zero, e - zero) for b, e, _ in more):
                    if merged and b <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([b, e])
                spans[row] = [{"begin": b, "end": e} for b, e in merged]
                ids[row] = sorted({x for _, _, items in more for x in items})
            return [pa.array(np.diff(words.first).astype(np.int64)), spans, ids]

        return function

    return make


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word positions, merged) and ``hit_items`` (sorted ids)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).filter("text is not null and text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    outputs = [("n_words", T.LongType()), ("hit_spans", SPANS), ("hit_items", T.ArrayType(T.StringType()))]
    context, names = spark.sparkContext, []
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).distinct().collect()
        windows = _windows([(r["item"], r["text"]) for r in rows], window)
        if blocks == 1:
            shared = context.broadcast(windows)
            return append_columns(docs, text, [text], outputs, _scan(lambda: [shared.value]))
        if not windows.tables:
            continue
        # the driver's own copy, from which executors fetch theirs
        path = os.path.join(tempfile.mkdtemp(), f"windows-{uuid.uuid4().hex}")
        names.append((os.path.basename(path), tuple(_save(windows, path))))
        context.addFile(path)
    return append_columns(docs, text, [text], outputs, _scan(lambda: [_opened(name, layout) for name, layout in names]))


def _aside(docs: DataFrame) -> dict[str, str]:
    """Other names for columns that are named as a result."""
    return {c: absent(docs.columns, f"{c}_") for c in docs.columns if c.lower() in ("n_words", "hit_spans", "hit_items")}


def n_hit_words(spans="hit_spans"):
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"]).cast("long"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window; columns as given."""
    aside = _aside(docs)
    found = find_contamination(docs.withColumnsRenamed(aside), benchmark, **options).filter(F.size("hit_spans") == 0)
    return found.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents with hit words (and what stands between them) cut out of the text."""

    def make():
        def function(texts, spans):
            out = []
            for value, cut in zip(texts, spans.to_pylist(), strict=True):
                if not cut or not value.is_valid:
                    out.append(value.as_py())
                    continue
                words, raw, at, parts = Words(pa.array([value.as_py()])), value.as_py().encode(), 0, []
                for s in cut:
                    parts.append(raw[at : words.start[s["begin"]]])
                    at = int(words.end[s["end"] - 1])
                out.append(b"".join([*parts, raw[at:]]).decode())
            return [out]

        return function

    aside = _aside(docs)
    found = find_contamination(docs.withColumnsRenamed(aside), benchmark, text=text, **options)
    own = absent(found.columns, "cut")
    cut = append_columns(found.withColumn(own, F.col(f"`{text}`")), own, [own, "hit_spans"], [(own, T.StringType())], make)
    return cut.withColumn(text, F.col(own)).select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))
