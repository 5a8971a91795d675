"""Cross-entropy difference of matched n-gram models (domain selection).

A target and a background model of equal form share one vocabulary: the words of either corpus. Words and
word pairs are counted over every text under 64-bit keys; nothing is pruned, hashed into slots or gathered on
one machine, and the counts grow with the input. Documents are dealt into buckets of bounded text. A bucket
sends its distinct keys with their own counts, packed, to the ranges of keys; a range adds up what all buckets
hold of it and answers each with the totals in the order of its keys; the answers meet the bucket's documents
again. Over ``1 << FAN_BITS`` buckets or ranges this goes by levels: a node of a level adds up the keys of one
wider range for one group of nodes below and sends on by narrower ranges, and totals come back the same way. So a
bucket makes at most that many packed rows a level, and their number is linear in the input but for the number of
levels. The loss of a word is -log of

    0.6 c(v, w) / c(v) + 0.39 c(w) / N + 0.01 / V        (v: the word before; pairs within a text)

and a document's score is the mean over its words of target loss less background loss: lower is
nearer to the target. With ``leave_own_out`` a document that is part of a corpus is scored by that corpus
without it, so none is near to itself only. Words are those of ``textnp``. Null and empty texts have no words and
null losses; an empty corpus leaves the uniform part alone. Repeated rows count as often as they stand; rows that
are alike in every column share a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, text_sizes
from .textnp import Words, mixed

#: Bytes of text of a bucket of documents.
BUCKET = 8 << 20
#: Bytes of text whose keys make one range on average.
RANGE = 16 << 20
#: Bits of a key that a level of the exchange tells apart; 2**FAN_BITS nodes are added up in one. The wider, the fewer
#: levels, each of which writes the counts again: one up to 8 GB of text, two up to 8 TB, while a row still packs a thousand keys.
FAN_BITS = 10
#: Words that a task gathers before it hands its counts on.
GATHERED = 4 << 20
PAIR, UNIGRAM, FLOOR = 0.6, 0.39, 0.01
OUTPUTS = [("n_words", T.LongType()), ("target_loss", T.DoubleType()), ("background_loss", T.DoubleType()), ("difference", T.DoubleType())]


def _keys(words: Words):
    """Keys of the words (even) and of the pairs (word before, word) that end in them (odd), and which words have one before."""
    h = words.hash
    before = np.append(np.zeros(1, np.uint64), h[:-1]) if len(h) else h
    pair = mixed(before * np.uint64(0xD6E8FEB86659FD93) + h)
    follows = np.ones(len(h), bool)
    follows[words.first[:-1][np.diff(words.first) > 0]] = False
    return h & ~np.uint64(1), pair | np.uint64(1), follows


def _tally(keys: list[np.ndarray], *weights: list[np.ndarray]):
    """Sorted distinct keys and the sum of each kind of weight."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, *(np.bincount(at, np.concatenate(w), len(found)).astype(np.int64) for w in weights)


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed: the equal leading bytes of sorted or small numbers cost nothing."""
    return pa.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, n * 8, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view("<u8")


def _size(rows: DataFrame, marks: DataFrame | None):
    """Words of the target, words of the background, distinct words of either."""
    marked = marks is not None

    def count(batches):
        keys, ours, theirs, size = [], [], [], 0

        def made(kind, key, t, b):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(t), pa.array(b)], names=["kind", "key", "t", "b"])

        for batch in batches:
            for part in steps(batch, text_sizes(batch.column(0))):
                words = Words(part.column(0))
                found, at = np.unique(words.hash & ~np.uint64(1), return_inverse=True)
                for many, into in ((part.column(1), ours), (part.column(2), theirs)):
                    into.append(np.bincount(at, many.to_numpy()[words.doc], len(found)))
                keys.append(found)
                size += len(found)
                if marked:  # the length of each row, which counts for the target if a mark meets it
                    n = np.diff(words.first).astype(np.int64)
                    yield made(1, part.column(3).to_numpy(), n, np.zeros(len(n), np.int64))
                if size > GATHERED:
                    yield made(0, *_tally(keys, ours, theirs))
                    keys, ours, theirs, size = [], [], [], 0
        if size:
            yield made(0, *_tally(keys, ours, theirs))

    each = rows.select("__text", "__t", "__b", "__h").mapInArrow(count, "kind int, key long, t long, b long").withColumn("mark", F.lit(False))
    if marked:
        zero = F.lit(0).cast("long")
        each = each.unionByName(marks.select(F.lit(1).alias("kind"), F.col("__h").alias("key"), zero.alias("t"), zero.alias("b"), F.lit(True).alias("mark")))
    each = each.groupBy("kind", "key").agg(F.sum("t").alias("t"), F.sum("b").alias("b"), F.max("mark").alias("mark")).filter("(kind = 0 and (t > 0 or b > 0)) or mark")
    t, b, n = each.agg(F.sum("t"), F.sum("b"), F.count_if(F.col("kind") == 0)).first()
    return float(t or 0), float(b or 0), max(n, 1)


ASKED = "grp long, pre long, to_grp long, to_pre long, n long, keys binary, t binary, b binary"
ANSWERED = "grp long, pre long, to_pre long, n long, t binary, b binary"


def _bits_at(buckets: int, bits: int) -> list[int]:
    """Leading bits of a key that are settled at each level, from 0 to ``bits``: the shape of the exchange.

    At level k a node holds one range of keys for 2**(k * FAN_BITS) buckets, at the last for all.
    """
    depth = max(1, -(-bits // FAN_BITS), -(-(buckets - 1).bit_length() // FAN_BITS))
    return [min(bits, level * FAN_BITS) for level in range(depth + 1)]


def _asks(keys: np.ndarray, t: np.ndarray, b: np.ndarray, grp: int, pre: int, known: int, wanted: int, group_bits: int) -> pa.Table:
    """A node's sorted keys, which share ``known`` leading bits, with their counts as one packed row for each range by ``wanted`` bits."""
    step = wanted - known
    first = pre << step
    edges = np.arange(first, first + (1 << step), dtype=np.uint64) << np.uint64(64 - wanted) if wanted else np.zeros(1, np.uint64)
    at = np.append(np.searchsorted(keys, edges), len(keys))
    many = np.diff(at)
    full = np.flatnonzero(many)
    packed = [pa.array([_packed(x[at[r] : at[r + 1]]) for r in full], pa.binary()) for x in (keys, t, b)]
    alike = (pa.array(np.full(len(full), x, np.int64)) for x in (grp, pre, grp >> group_bits))
    return pa.table([*alike, pa.array(full.astype(np.int64) + first), pa.array(many[full].astype(np.int64)), *packed], names=["grp", "pre", "to_grp", "to_pre", "n", "keys", "t", "b"])


def _arrays(rows: pa.Table, *names: str) -> list[list[np.ndarray]]:
    many = rows.column("n").to_pylist()
    return [[_unpacked(data, n) for data, n in zip(rows.column(name).to_pylist(), many, strict=True)] for name in names]


def _replies(asks: pa.Table, at: np.ndarray, totals: list[np.ndarray]) -> pa.Table:
    """What each row of ``asks`` is told: the totals, at the places ``at``, in the order of its keys."""
    ends = np.cumsum(asks.column("n").to_numpy())[:-1]
    packed = [pa.array([_packed(x) for x in np.split(total[at], ends)], pa.binary()) for total in totals]
    return pa.table([*(asks.column(c) for c in ("grp", "pre", "to_pre", "n")), *packed], names=["grp", "pre", "to_pre", "n", "t", "b"])


def _told(answers: pa.Table) -> list[np.ndarray]:
    """Totals in the order of the keys that were asked for."""
    return [np.concatenate(x or [np.empty(0, np.uint64)]).astype(np.int64) for x in _arrays(answers.sort_by("to_pre"), "t", "b")]


def _sent_on(asks: DataFrame, known: int, wanted: int) -> DataFrame:
    """What nodes, having added up what reached them, ask of the level above."""
    group_bits = FAN_BITS

    def add(got: pa.Table) -> pa.Table:
        keys, t, b = _arrays(got, "keys", "t", "b")
        return _asks(*_tally(keys, t, b), got.column("to_grp")[0].as_py(), got.column("to_pre")[0].as_py(), known, wanted, group_bits)

    return asks.groupBy("to_grp", "to_pre").applyInArrow(add, ASKED)


def _answers(asks: DataFrame, levels: list[int]) -> DataFrame:
    """The totals over all buckets for each row of ``asks``, which nodes with the first of ``levels`` settled have to answer."""

    def final(got: pa.Table) -> pa.Table:
        keys, t, b = _arrays(got, "keys", "t", "b")
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        return _replies(got, at, [np.bincount(at, np.concatenate(x)).astype(np.int64) for x in (t, b)])

    def handed_down(got: pa.Table, answers: pa.Table) -> pa.Table:
        _, at = np.unique(np.concatenate(_arrays(got, "keys")[0]), return_inverse=True)
        return _replies(got, at, _told(answers))

    if len(levels) == 1:
        return asks.groupBy("to_grp", "to_pre").applyInArrow(final, ANSWERED)
    above = _answers(_sent_on(asks, *levels[:2]), levels[1:])
    return asks.groupBy("to_grp", "to_pre").cogroup(above.groupBy("grp", "pre")).applyInArrow(handed_down, ANSWERED)


def _parts(rows: pa.Table):
    for batch in rows.to_batches():
        yield from steps(batch, text_sizes(batch.column("__text")))


def _own(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each key stands in its own document."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    begins = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.empty(0, np.int64)
    many = np.diff(np.append(begins, len(key)))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(many, many)
    return out


def _losses(single: np.ndarray, double: np.ndarray, follows: np.ndarray, total: np.ndarray, size: int) -> np.ndarray:
    """-log p of each word from the counts of the words and of the pairs that end in them."""
    before = np.maximum(np.append([1.0], single[:-1]) if len(single) else np.empty(0), 1.0)
    share = single / np.maximum(total, 1.0)
    return -np.log(PAIR * np.where(follows, np.minimum(double / before, 1.0), share) + UNIGRAM * share + FLOOR / size)


def _flagged(bucket: pa.Table) -> pa.Table:
    """The rows with text; those that a row without text, of equal hash, marks are of the target."""
    said = pc.is_valid(bucket.column("__text"))
    body, marks = bucket.filter(said), bucket.filter(pc.invert(said)).column("__h")
    if not len(marks):
        return body
    return body.set_column(body.column_names.index("__t"), "__t", pc.is_in(body.column("__h"), value_set=marks).cast(pa.int32()))


def _scores(rows: DataFrame, kept: list[T.StructField], leave_own_out: bool, size: int | None, marks: DataFrame | None = None) -> DataFrame:
    """``rows``: the kept columns (numbered, see ``_carried``), __text, __t and __b (times a row counts in target and background), __scored, __h.

    ``marks``: values of __h whose rows are of the target.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in OUTPUTS)])
    kinds = to_arrow_schema(schema)
    own = [F.col(f"`{f.name}`") for f in kept]
    silent = rows.filter("__scored and (__text is null or __text = '')")
    wordless = silent.select(*own, F.lit(0).cast("long").alias("n_words"), *(F.lit(None).cast("double").alias(n) for n, _ in OUTPUTS[1:]))
    spoken = rows.filter("__text <> ''")
    ours, theirs, distinct = _size(spoken, marks)
    size = size or distinct
    n_bytes = spoken.agg(F.sum(F.octet_length("__text").cast("long"))).first()[0] or 0
    if marks is not None:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in kept]
        spoken = spoken.unionByName(marks.select(*nothing, *_row(F.lit(None).cast("string"), F.lit(0), F.lit(0), False, F.col("__h"))))
    buckets = n_bytes // BUCKET + 1
    dealt = spoken.withColumn("__bucket", F.pmod("__h", F.lit(buckets)))
    levels = _bits_at(buckets, (n_bytes // RANGE).bit_length())
    wanted, group_bits = levels[1], FAN_BITS

    def keys_of(bucket: pa.Table):
        """Distinct keys of a bucket in order, with their counts in it."""
        keys, t, b = [np.empty(0, np.uint64)], [np.empty(0)], [np.empty(0)]
        for part in _parts(bucket):
            words = Words(part.column("__text"))
            word, pair, follows = _keys(words)
            found, at = np.unique(np.concatenate([word, pair[follows]]), return_inverse=True)
            doc = np.concatenate([words.doc, words.doc[follows]])
            keys.append(found)
            for name, into in (("__t", t), ("__b", b)):
                into.append(np.bincount(at, part.column(name).to_numpy()[doc], len(found)))
        return _tally(keys, t, b)

    def asked(bucket: pa.Table) -> pa.Table:
        return _asks(*keys_of(_flagged(bucket)), bucket.column("__bucket")[0].as_py(), 0, 0, wanted, group_bits)

    def scored(bucket: pa.Table, answers: pa.Table) -> pa.Table:
        bucket = _flagged(bucket)
        if not pc.any(bucket.column("__scored")).as_py():
            return pa.Table.from_batches([], kinds)
        keys = keys_of(bucket)[0]
        models = [x.astype(np.float64) for x in _told(answers)]
        made = []
        for part in _parts(bucket):
            words = Words(part.column("__text"))
            word, pair, follows = _keys(words)
            at, pair_at = np.searchsorted(keys, word), np.zeros(len(word), np.int64)
            pair_at[follows] = np.searchsorted(keys, pair[follows])
            n = np.diff(words.first)
            mine = (_own(words.doc, word), _own(words.doc, np.where(follows, pair, np.uint64(0)))) if leave_own_out else (0, 0)
            means = []
            for model, total, name in zip(models, (ours, theirs), ("__t", "__b"), strict=True):
                times = part.column(name).to_numpy()[words.doc] if leave_own_out else 0
                single, double = model[at] - mine[0] * times, model[pair_at] - mine[1] * times
                left = total - n[words.doc] * times if leave_own_out else np.full(len(word), total)
                up = np.concatenate([[0.0], np.cumsum(_losses(single, double, follows, left, size))])
                means.append((up[words.first[1:]] - up[words.first[:-1]]) / np.maximum(n, 1))
            columns = [np.round(m, 6) for m in (means[0], means[1], means[0] - means[1])]
            new = [pa.array(n.astype(np.int64)), *(pa.array(c, pa.float64(), mask=n == 0) for c in columns)]
            whole = pa.RecordBatch.from_arrays([*(part.column(f.name).cast(kinds.field(f.name).type) for f in kept), *new], schema=kinds)
            made.append(whole.filter(part.column("__scored")))
        return pa.Table.from_batches(made, kinds)

    asks = dealt.groupBy("__bucket").applyInArrow(asked, ASKED)
    answers = _answers(asks, levels[1:])
    return dealt.groupBy("__bucket").cogroup(answers.groupBy("grp")).applyInArrow(scored, schema).unionByName(wordless)


def _kept(docs: DataFrame, text: str) -> list[T.StructField]:
    return [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields if f.name not in [text, *(name for name, _ in OUTPUTS)]]


def _carried(kept: list[T.StructField]) -> list[T.StructField]:
    """The kept columns under names that none of those used here can clash with."""
    return [T.StructField(f"k{i}", f.dataType, True) for i, f in enumerate(kept)]


def _named(scores: DataFrame, kept: list[T.StructField]) -> DataFrame:
    return scores.toDF(*(f.name for f in kept), *(name for name, _ in OUTPUTS))


def _row(text: Column, target: Column, background: Column, scored: bool, h: Column) -> list[Column]:
    return [text.alias("__text"), target.cast("int").alias("__t"), background.cast("int").alias("__b"), F.lit(scored).alias("__scored"), h.alias("__h")]


def _hash(docs: DataFrame) -> Column:
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, background: DataFrame, *, text: str = "text", word_bits: int | None = None, pair_bits: int | None = None) -> DataFrame:
    """``docs``, but for the text, with n_words, target_loss, background_loss (mean per word) and their difference.

    V is the number of distinct words of both corpora, or ``2**word_bits`` if that is given; ``pair_bits`` is taken
    for the sake of earlier callers and has no effect. Columns of ``docs`` named as a result are replaced.
    """
    kept = _kept(docs, text)
    said = F.col(f"`{text}`")
    carried = _carried(kept)
    rows = docs.select(*(F.col(f"`{f.name}`").alias(c.name) for f, c in zip(kept, carried, strict=True)), *_row(said, F.lit(0), F.lit(0), True, _hash(docs)))
    for corpus, t, b in ((target, 1, 0), (background, 0, 1)):
        none = [F.lit(None).cast(c.dataType).alias(c.name) for c in carried]
        rows = rows.unionByName(corpus.select(*none, *_row(said, F.lit(t), F.lit(b), False, _hash(corpus))))
    return _named(_scores(rows, carried, False, None if word_bits is None else 1 << word_bits), kept)


def score_within(docs: DataFrame, target_ids: DataFrame, *, doc_id: str = "doc_id", text: str = "text", leave_own_out: bool = True) -> DataFrame:
    """``docs``, but for the text, with the same four columns: all are the background, those in ``target_ids`` the target.

    Which row is of the target is found on ids and hashes alone, so that each text is shuffled once only, into its bucket.
    """
    kept = _kept(docs, text)
    carried = _carried(kept)
    rows = docs.select(*(F.col(f"`{f.name}`").alias(c.name) for f, c in zip(kept, carried, strict=True)), *_row(F.col(f"`{text}`"), F.lit(0), F.lit(1), True, _hash(docs)))
    ids = target_ids.select(F.col(f"`{target_ids.columns[0]}`").alias("__id")).distinct()
    small = docs.filter(F.col(f"`{text}`") != "").select(F.col(f"`{doc_id}`").alias("__id"), _hash(docs).alias("__h"))
    marks = small.join(ids.hint("merge"), "__id", "left_semi").select("__h").distinct()
    return _named(_scores(rows, carried, leave_own_out, None, marks), kept)
