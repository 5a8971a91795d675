"""Token counts by field and section from one encoding of the whole document.

The fields of a document are joined (``lang`` and ``source`` a line each, then the text), the whole is
encoded once, and the tokens' byte spans (a running sum of token lengths) are joined to the sections'
intervals by binary search. Sections: the leading fields, then every line of the text; a line's interval
includes its line break. A token across a boundary goes by ``rule``: ``first`` to the section of its first
byte, ``last`` to that of its last byte, ``most`` to the one that has most of its bytes (the earliest
of equals). So the sections' counts always sum to the document's.

Null fields and texts are empty; an empty text is one empty line. Special-token strings are ordinary text. Texts of any
length are encoded whole: a run of white space of over 65,536 characters, too long for the encoder's pattern, is handed to its merges as the
piece that the pattern makes of it; repeated rows count alike; columns named as a result are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=1)
def _encoder(ranks: bytes):
    """The encoder and the bytes of each token; a worker keeps them between tasks."""
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    width = np.zeros(max(table.values()) + 1, np.int64)
    for token, i in table.items():
        width[i] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}), width


#: White space as the encoder's pattern has it.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_LONG = 1 << 16


def encoded(encoder, text: str) -> list[int]:
    """The tokens of a text. The pattern makes one piece of a run of white space, but for its last character where text follows."""
    if len(text) <= _LONG:
        return encoder.encode_ordinary(text)
    out, at = [], 0
    for run in _SPACE.finditer(text):
        if run.end() - run.start() > _LONG:
            end = run.end() - (run.end() < len(text))
            out += encoder.encode_ordinary(text[at : run.start()])
            out += encoder._encode_single_piece(text[run.start() : end])
            at = end
    return out + encoder.encode_ordinary(text[at:])


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section and how many tokens cross a boundary; section i is bounds[i]:bounds[i+1]."""
    sections = len(bounds) - 1
    first = np.minimum(np.searchsorted(bounds, starts, side="right") - 1, sections - 1)
    last = np.minimum(np.searchsorted(bounds, ends - 1, side="right") - 1, sections - 1)
    if rule == "first":
        to = first
    elif rule == "last":
        to = last
    elif rule == "most":
        to = first.copy()
        for i in np.flatnonzero(first != last):
            inside = [min(ends[i], bounds[s + 1]) - max(starts[i], bounds[s]) for s in range(first[i], last[i] + 1)]
            to[i] = first[i] + int(np.argmax(inside))
    else:
        raise ValueError(f"no such rule: {rule}")
    return np.bincount(to, minlength=sections), int((first != last).sum())


def count_tokens(docs: DataFrame, *, text: str = "text", fields: tuple[str, ...] = ("lang", "source"), rule: str = "first", ranks: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, field_tokens (array, as ``fields``), line_tokens (array), crossing_tokens."""
    with open(ranks or default_path(), "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        encoder, width = _encoder(shared.value)

        def function(texts, *others):
            rows = []
            for value, *lead in zip(texts.to_pylist(), *(o.to_pylist() for o in others), strict=True):
                head = [f"{x or ''}\n" for x in lead]
                lines = (value or "").split("\n")
                whole = "".join(head) + (value or "")
                sizes = [*(len(x.encode()) for x in head), *(len(x) + 1 for x in (value or "").encode().split(b"\n"))]
                sizes[-1] -= 1
                ends = np.cumsum(width[np.asarray(encoded(encoder, whole), np.int64)])
                starts = np.append([0], ends[:-1])[: len(ends)]
                counts, crossing = attribute(starts, ends, np.concatenate([[0], np.cumsum(sizes)]), rule)
                rows.append((len(ends), counts[: len(head)].tolist(), counts[len(head) :].tolist(), crossing, len(lines)))
            return [pa.array([r[i] for r in rows]) if i in (0, 3) else [r[i] for r in rows] for i in range(4)]

        return function

    many = T.ArrayType(T.LongType())
    outputs = [("n_tokens", T.LongType()), ("field_tokens", many), ("line_tokens", many), ("crossing_tokens", T.LongType())]
    return append_columns(docs, text, [text, *fields], outputs, make)


def digest(column: str):
    """SHA-256 of an array's numbers joined with commas."""
    return F.sha2(F.array_join(F.col(column).cast("array<string>"), ","), 256)
