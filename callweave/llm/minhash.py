"""MinHash fingerprints: universal hash permutations over word shingles, in vectorised numpy.

Shingles are runs of ``ngram`` words (see ``textnp``); a text of fewer words is one shingle, one without
words has a signature of its own (all ones). A permutation is x -> a x + b modulo 2^64 with odd a;
``n_perm`` minima make the signature, whose agreement estimates the Jaccard similarity. The printed
fingerprint keeps eight bits of each minimum; its likeness is corrected for chance agreement.

Near-duplicate links: signatures are cut into bands, bands are joined in Spark between classes of texts with equal
shingles, and each candidate's Jaccard similarity is verified on its shingles (see ``nearcopies``). Nulls are empty
texts; repeated rows have equal fingerprints; an empty table gives none. Texts of any length are read whole, in pieces.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpointed
from .textnp import Words

EMPTY = np.uint32(0xFFFFFFFF)
#: Buckets of ids, and of null ids, at most: the driver holds one row for each. A larger table has larger buckets, which are streamed.
MOST_BUCKETS = 20_000


def _permutations(n_perm: int, seed: int):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n_perm, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n_perm, np.uint64) * np.uint64(2)


def shingles(texts: pa.Array, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the shingle hashes of row i are hashes[first[i]:first[i+1]]."""
    words = Words(texts)
    at, hashes = words.windows(ngram)
    doc = words.doc[at]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < ngram))
    for length in np.unique(counts[short]):
        more, h = words.windows(int(length))
        own = counts[words.doc[more]] == length
        doc, hashes = np.append(doc, words.doc[more[own]]), np.append(hashes, h[own])
    order = np.argsort(doc, kind="stable")
    return hashes[order], np.searchsorted(doc[order], np.arange(len(counts) + 1))


def signatures_of(texts: pa.Array, ngram: int = 5, n_perm: int = 128, seed: int = 7) -> np.ndarray:
    """A row of ``n_perm`` 32-bit minima for each text."""
    a, b = _permutations(n_perm, seed)
    hashes, first = shingles(texts, ngram)
    out = np.full((len(texts), n_perm), EMPTY, np.uint32)
    buffer = np.empty((512, n_perm), np.uint64)
    for row in np.flatnonzero(np.diff(first)):
        best = None
        for i in range(first[row], first[row + 1], 512):
            x = hashes[i : min(i + 512, first[row + 1]), None]
            y = buffer[: len(x)]
            np.multiply(x, a, out=y)
            y += b
            low = y.min(axis=0)
            best = low if best is None else np.minimum(best, low)
        out[row] = best >> np.uint64(32)
    return out


def short_prints(signatures: np.ndarray) -> np.ndarray:
    """Eight bits of each minimum."""
    return ((signatures * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of short prints, row by row."""
    return np.clip(((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def signatures(docs: DataFrame, *, text: str = "text", ngram: int = 5, n_perm: int = 128) -> DataFrame:
    """``docs`` with ``signature`` (binary, four bytes a minimum)."""

    def make():
        def function(texts):
            return [[row.tobytes() for row in signatures_of(texts, ngram, n_perm)]]

        return function

    return append_columns(docs, text, [text], [("signature", T.BinaryType())], make)


def near_duplicate_links(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Bands of signatures joined in Spark, similarity verified (see ``nearcopies.near_duplicate_links``)."""
    from . import nearcopies

    return nearcopies.near_duplicate_links(docs, **options)


# ---------------------------------------------------------------- each text and its successor


def with_edits(docs: DataFrame, *, ngram: int = 5, n_perm: int = 128, rows_per_bucket: int = 1024) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document follows in descending doc_id (ties by a hash of the text, then the text; null ids
    last), after the last comes the first. Buckets of ids are consecutive in that order; each text is
    shuffled once, into its bucket, and the first row of every bucket also into the bucket before.
    Ids that fill buckets of their own (a hot id, nulls) are split by the hash of the text.
    """
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    counted = base.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    wanted = min(max(1, counted["n"] // rows_per_bucket), MOST_BUCKETS)
    points = base.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 1 / (8 * wanted)) if wanted > 1 and counted["ids"] else []
    heavy = {v: n for v, n in Counter(points).items() if n >= 4}
    nulls = min(max(1, (counted["n"] - counted["ids"]) // rows_per_bucket), MOST_BUCKETS)
    splits = [float("-inf"), *sorted(set(points)), float("inf")]
    ranged = base.withColumn("number", F.col("doc_id").cast("double"))
    if len(splits) > 2:
        ranged = Bucketizer(splits=splits, inputCol="number", outputCol="range", handleInvalid="keep").transform(ranged)
    else:
        ranged = ranged.withColumn("range", F.lit(0.0))
    share = lambda parts: F.floor((F.shiftrightunsigned("h", 11).cast("double") / float(1 << 53)) * parts)
    sub = F.when(F.col("doc_id").isNull(), share(F.lit(nulls)))
    for value, parts in heavy.items():
        sub = sub.when(F.col("number") == value, share(F.lit(parts)) + 1)
    order = F.when(F.col("doc_id").isNull(), F.lit(len(splits))).otherwise(F.lit(len(splits)) - 1 - F.col("range"))
    keyed = ranged.select("doc_id", "text", "h", (order.cast("long") * (1 << 20) + F.coalesce(sub, F.lit(0)).cast("long")).alias("bucket"))
    # unsigned order of the hash, as the shares of hot ids are cut
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("last"), (-F.col("doc_id")).alias("down"), F.hex("h").alias("x")))
    firsts = sorted((r["bucket"], r["f"]) for r in keyed.groupBy("bucket").agg(first_row.alias("f")).collect())
    if not firsts:
        before = spark.createDataFrame([], "bucket long, down long, x string, previous long")
    else:
        rows = [(b, f["down"], f["x"], firsts[i - 1][0]) for i, (b, f) in enumerate(firsts)]
        before = spark.createDataFrame(rows, "bucket long, down long, x string, previous long")
    # a bounded table: one row for each bucket
    marked = keyed.join(F.broadcast(before), "bucket")
    is_first = (-F.col("doc_id")).eqNullSafe(F.col("down")) & (F.hex("h") == F.col("x"))
    main = F.struct(F.col("bucket"), F.lit(False).alias("tail"))
    copies = F.when(is_first, F.array(main, F.struct(F.col("previous").alias("bucket"), F.lit(True).alias("tail")))).otherwise(F.array(main))
    sent = marked.select("doc_id", "text", F.hex("h").alias("x"), F.explode(copies).alias("c")).select("c.bucket", "c.tail", "doc_id", "x", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(firsts) // 4))
    placed = sent.repartition(parts, "bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "x", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        waiting = None  # (bucket, doc_id, text): a row whose successor has not come yet
        ready: list[tuple] = []
        size = 0

        def flush():
            ids, texts, nexts = zip(*ready, strict=True)
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts, strict=True)]
            ready.clear()
            own = short_prints(signatures_of(pa.array(texts, pa.string()), ngram, n_perm))
            # a text's successor is the next one here, but at the edges
            other = np.empty_like(own)
            other[:-1] = own[1:]
            odd = [i for i, n in enumerate(nexts) if i + 1 == len(texts) or n is not texts[i + 1]]
            other[odd] = short_prints(signatures_of(pa.array([nexts[i] for i in odd], pa.string()), ngram, n_perm))
            new = short_prints(signatures_of(pa.array(edited, pa.string()), ngram, n_perm))
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([p.tobytes().hex() for p in own]),
                pa.array([p.tobytes().hex() for p in new]),
                pa.array(likeness(own, new)),
                pa.array(likeness(own, other)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for bucket, tail, doc, text in zip(*(part.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True):
                    if waiting is not None and waiting[0] == bucket:
                        ready.append((waiting[1], waiting[2], text))
                        size += len(text)
                        waiting = None
                    if not tail:
                        waiting = (bucket, doc, text)
                    if size > 1 << 20:
                        yield flush()
                        size = 0
        if ready:
            yield flush()

    return placed.mapInArrow(run, schema)
