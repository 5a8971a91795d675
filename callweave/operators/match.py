"""Fuzzy matching of read labels to a roster."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings without regard to case, 0 to 1; depends on their order."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def register(spark) -> None:
    """Makes ``seq_ratio`` known to SQL."""
    spark.udf.register("seq_ratio", sequence_ratio)


#: Candidates of a roster at most: a task holds all of them, with 256 bytes of letter counts for each.
LARGEST_ROSTER = 200_000
BINS = 64


class RosterIndex:
    """The candidates of a roster with their letter counts, from which similarities are bounded before any text is aligned.

    Two strings of a and b letters with at most m of them in common (counted as multisets, letters dealt into ``BINS`` classes) have
    a ratio of 2m / (a + b) at most. Candidates are aligned by falling bound, until it is below the best ratio found.
    """

    def __init__(self, rows: list[tuple[int, str, str]]):
        self.rows = [(member, canonical, candidate.lower()) for member, canonical, candidate in rows]
        self.sizes = np.array([len(c) for _, _, c in self.rows], np.int64)
        self.counts = np.zeros((BINS, len(self.rows)), np.int32)
        letters = np.frombuffer("".join(c for _, _, c in self.rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        np.add.at(self.counts, (letters % BINS, np.repeat(np.arange(len(self.rows)), self.sizes)), 1)

    def best(self, text: str) -> tuple[float, str | None, int]:
        """(score, canonical name, candidates aligned): the highest ratio, of the earliest member where several reach it."""
        if not self.rows:
            return 0.0, None, 0
        text = text.lower()
        said = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % BINS, minlength=BINS)
        bins = np.flatnonzero(said)
        common = np.minimum(self.counts[bins], said[bins, None]).sum(0)
        whole = self.sizes + len(text)
        bound = np.where(whole > 0, 2.0 * common / np.maximum(whole, 1), 1.0)
        first = int(np.argmax(bound))
        found, aligned = (-1.0, 0, None), 0
        floor = SequenceMatcher(None, text, self.rows[first][2]).ratio()
        near = np.flatnonzero(bound >= floor)
        for i in near[np.argsort(-bound[near], kind="stable")].tolist():
            if bound[i] < found[0]:
                break
            member, canonical, candidate = self.rows[i]
            aligned += 1
            ratio = SequenceMatcher(None, text, candidate).ratio()
            if (ratio, -member) > found[:2]:
                found = (ratio, -member, canonical)
        return found[0], found[2], aligned


def match_labels(labels: DataFrame, candidates: DataFrame, *, label: str = "raw", self_name: str = "You", threshold: float = 0.72) -> DataFrame:
    """(label, name, score) of each distinct label: ``you`` is oneself, else the best candidate above the threshold.

    ``candidates``: member_ord, canonical, candidate: a roster of up to ``LARGEST_ROSTER`` rows, else ValueError. Labels are
    made distinct first, so each is looked up once, however many frames show it. Ties go to the earlier member.
    """
    distinct = labels.select(label).filter(F.col(label).isNotNull()).distinct().withColumn("clean", F.trim(label))
    roster_rows = candidates.select("member_ord", "canonical", "candidate").limit(LARGEST_ROSTER + 1).collect()
    if len(roster_rows) > LARGEST_ROSTER:
        raise ValueError(f"a roster has {LARGEST_ROSTER} candidates at most")
    rows = [tuple(r) for r in roster_rows if r["candidate"] is not None]

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = RosterIndex(rows)
        for pdf in batches:
            found = [index.best(clean) for clean in pdf["clean"]]
            yield pdf.assign(score=[f[0] for f in found], canonical=[f[1] for f in found])

    kinds = T.StructType([*distinct.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("canonical", T.StringType())])
    best = distinct.mapInPandas(look_up, kinds)
    name = F.when(F.lower("clean") == "you", F.lit(self_name)).when((F.col("score") > 0) & (F.col("score") >= F.lit(threshold)), F.col("canonical"))
    return best.select(label, name.alias("name"), "score")


def caption_speakers(lines: DataFrame, candidates: DataFrame, *, text: str = "text", self_name: str = "You", threshold: float = 0.72) -> DataFrame:
    """(text, name): lines that are nothing but a speaker's name, four words at most."""
    key = F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z' ]", ""))
    short = lines.select(text).distinct().withColumn("key", key).filter((F.col("key") != "") & (F.size(F.split(F.trim("key"), r"\s+")) <= 4))
    found = match_labels(short, candidates, label="key", self_name=self_name, threshold=threshold).filter("name is not null")
    return short.join(found.select("key", "name"), "key").select(text, "name")
