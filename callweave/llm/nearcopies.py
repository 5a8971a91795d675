"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with one set of shingles are a class and count once; a text without words is of the class of its very text.
SimHash alone cannot find all such pairs (two texts of similarity 0.8 differ in ten of 64 bits on average), so candidates
come from bands of MinHash minima, ``bands`` of five each, which miss under two pairs in a thousand at 0.8. Within
a band's bucket the operator of ``simhash`` works as it does everywhere: the SimHash fingerprints of the classes are sorted by Gray rank
and made into a tree, whose pairs of nodes are pruned by the bits they share and by the components they belong to. Pairs
left are held against a sketch (eight bits of each of 128 minima), and what passes is decided by the exact
similarity of the shingle sets. There are two passes:

1. Each bucket gives a spanning forest of the pairs that the sketch puts at the similarity wanted. Verified, they make
   groups of nearly all copies.
2. In buckets that still hold several groups the shingle sets themselves come along. Every pair across groups that sizes and sketch
   cannot rule out is decided on the spot, exactly, in the first bucket that the two share, unless links found there have joined their
   groups already. Only a spanning forest of true links leaves the task, however many texts lie just below the bound.

A bucket of more than ``hot`` classes is dealt over cells of bounded size (in the second pass, of rows and of bytes). In the first pass a few
leaders go to all cells; in the second those outside the bucket's largest group meet all its members, cell by cell. So no group of
copies is ever in one task and no pair across groups is left out.

Nulls are empty texts. Rows with a null id come last among copies. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import absent, append_columns, checkpointed
from .minhash import shingles, short_prints, signatures_of
from .simhash import GrayTree, bucket_rows, components

N_PERM, WIDTH = 128, 5
#: Differing bits of SimHash fingerprints beyond which a pair is not looked at: at similarity 0.8 ten are expected, with a deviation of three.
MAX_BITS = 22
#: How far below the similarity wanted a sketch may be in the second pass: over three deviations.
MARGIN = 0.12
LEADERS = 4
#: Bytes of shingle sets that a cell of the second pass holds (and four times ``hot`` rows).
CELL_BYTES = 1 << 25


# ---------------------------------------------------------------- classes


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _id_key(doc_id: str) -> Column:
    """An id of any type, null too, as text that no other id has."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{doc_id}`").cast("string")), F.lit("null"))


def _votes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The SimHash fingerprint of each row's hashes; zero without any."""
    out = np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, first[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(counts * 2 > np.diff(first)[full, None], axis=1).view(">u8").reshape(-1)
    return out


def _prints(ngram: int, bands: int):
    def make():
        def function(texts):
            hashes, first = shingles(texts, ngram)
            signatures = signatures_of(texts, ngram, N_PERM)
            value = _votes(hashes, first).view(np.int64)
            classes, widths = [], []
            for i, text in enumerate(texts):
                own = np.unique(hashes[first[i] : first[i + 1]])
                widths.append(len(own))
                classes.append(hashlib.blake2b(own.tobytes() or b"\0" + (text.as_py() or "").encode(), digest_size=16).digest())
            keys = np.zeros((len(signatures), bands), np.uint64)
            for j in range(WIDTH):
                keys = (keys ^ signatures[:, j : WIDTH * bands : WIDTH]) * np.uint64(0x9E3779B97F4A7C15)
                keys ^= keys >> np.uint64(29)
            keys = (keys + np.arange(bands, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            lists = [k.view(np.int64).tolist() if n else [] for k, n in zip(keys, np.diff(first), strict=True)]
            return [classes, pa.array(value), [s.tobytes() for s in short_prints(signatures)], pa.array(lists, pa.list_(pa.int64())), pa.array(widths, pa.int32())]

        return function

    return make


def _sets(ngram: int):
    def make():
        def function(texts):
            hashes, first = shingles(texts, ngram)
            own = [np.unique(hashes[first[i] : first[i + 1]]) for i in range(len(texts))]
            ends = np.cumsum([0, *map(len, own)])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64)))]

        return function

    return make


# ---------------------------------------------------------------- candidates


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by sketches, which agree by chance in one place of 256."""
    return (np.count_nonzero(a == b, axis=1) / N_PERM - 1 / 256) / (1 - 1 / 256)


def _by_sketch(sketches: np.ndarray, least: float):
    """Tells which pairs the sketches put at ``least`` or more."""

    def accept(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), bool)
        for i in range(0, len(a), 1 << 15):
            out[i : i + (1 << 15)] = likeness(sketches[a[i : i + (1 << 15)]], sketches[b[i : i + (1 << 15)]]) >= least
        return out

    return accept


def _sketches(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, N_PERM)


def _buckets(key: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))


def _candidates(least: float):
    """Rows (key, cell, value, node, sketch), buckets together, to pairs (a, b) of nodes."""

    def pairs(key, cell, value, node, sketch):
        a, b = GrayTree(_buckets(key, cell), value.view(np.uint64), _by_sketch(_sketches(sketch), least)).forest(MAX_BITS)
        return node[a], node[b]

    return bucket_rows(pairs)


class SetPairs:
    """Exact similarity of pairs of sets of 64-bit numbers."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.marked = np.zeros(int(self.flat.max()) + 1 if len(self.flat) else 1, bool)

    def common(self, a: int, b: np.ndarray) -> np.ndarray:
        """Entries that set ``a`` shares with each set of ``b`` (none empty)."""
        own = self.flat[self.ends[a] : self.ends[a + 1]]
        self.marked[own] = True
        many = self.size[b]
        starts = np.cumsum(many) - many
        at = np.arange(many.sum()) + np.repeat(self.ends[b] - starts, many)
        out = np.add.reduceat(self.marked[self.flat[at]], starts, dtype=np.int64)
        self.marked[own] = False
        return out

    def alike(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Which pairs have a Jaccard similarity of ``least`` or more."""
        out = np.zeros(len(a), bool)
        small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        left = np.flatnonzero((small > 0) & (small >= least * large))
        left = left[np.argsort(a[left], kind="stable")]
        for part in np.split(left, np.flatnonzero(np.diff(a[left])) + 1):
            if len(part):
                shared = self.common(int(a[part[0]]), b[part])
                out[part] = shared / (self.size[a[part]] + self.size[b[part]] - shared) >= least
        return out


def _decided(least: float):
    """Rows (key, cell, value, node, component, sketch, bands, set), buckets together, to true links (a, b) between components."""

    def pairs(key, cell, value, node, component, sketch, bands, sets):
        by_sketch, exact = _by_sketch(_sketches(sketch), least - MARGIN), SetPairs(list(sets))
        bands = np.stack(bands)

        def accept(a, b):
            out = by_sketch(a, b)
            at = np.flatnonzero(out)
            first = np.argmax(bands[a[at]] == bands[b[at]], axis=1)
            here = bands[a[at], first] == key[a[at]]  # a pair is decided in the first bucket that it shares
            out[at[~here]] = False
            at = at[here]
            out[at] = exact.alike(a[at], b[at], least)
            return out

        a, b = GrayTree(_buckets(key, cell), value.view(np.uint64), accept).forest(MAX_BITS, component)
        return node[a], node[b]

    return bucket_rows(pairs, limit=1 << 12)


def _copies(cells: Column) -> Column:
    return F.explode(cells).alias("cell")


def _first_pass(members: DataFrame, sizes: DataFrame, hot: int) -> DataFrame:
    parts = F.ceil(F.col("n") / hot).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    leads = F.exists("leaders", lambda x: x == F.col("node"))
    cells = F.when(leads & (parts > 1), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    return members.join(sizes, "key").select("key", _copies(cells), "node")


def _second_pass(members: DataFrame, roots: DataFrame, widths: DataFrame, cell_rows: int) -> DataFrame:
    """Members of the buckets that hold several components, in cells of bounded rows and bytes."""
    rooted = members.join(roots, "node", "left").withColumn("component", F.coalesce("root", "node")).join(widths, "node")
    load = F.count("*") / cell_rows + F.sum("width") * 8 / CELL_BYTES
    each = rooted.groupBy("key", "component").agg(load.alias("load"))
    mixed = each.groupBy("key").agg(F.sum("load").alias("load"), F.max(F.struct("load", "component")).alias("top"), F.count("*").alias("components")).filter("components > 1")
    marked = rooted.join(mixed.select("key", "load", F.col("top.load").alias("most"), F.col("top.component").alias("largest")), "key")
    parts = F.ceil("load").cast("int")
    outside = F.greatest(F.ceil(F.col("load") - F.col("most")), F.lit(1)).cast("int")
    row, column = F.pmod(F.xxhash64("node"), parts).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), outside).cast("int")
    as_member = F.transform(F.sequence(F.lit(0), outside - 1), lambda j: row * outside + j)
    as_other = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: i * outside + column)
    cells = F.when((parts > 1) & (F.col("component") != F.col("largest")), F.array_distinct(F.concat(as_member, as_other))).otherwise(as_member)
    return marked.select("key", _copies(cells), "node", "component")


def _searched(rows: DataFrame, search) -> DataFrame:
    """Distinct pairs (a, b) from rows whose first columns are key and cell."""
    found = rows.withColumn("cell", F.col("cell").cast("long")).repartition("key", "cell").sortWithinPartitions("key", "cell")
    return found.mapInArrow(search, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, min_jaccard: float) -> DataFrame:
    """(a, b, jaccard) of the pairs that are similar enough; two sets at a time are in memory."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    measured = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return measured.select("a", "b", (F.col("common") / (F.col("sizes") - F.col("common"))).alias("jaccard")).filter(F.col("jaccard") >= F.lit(float(min_jaccard)))


# ---------------------------------------------------------------- groups


def _grouped(docs: DataFrame, doc_id: str, text: str, ngram: int, min_jaccard: float, bands: int, hot: int):
    """(rows, classes, links): rows (doc_id, h, class), classes (class, node, first, root), links (a, b, jaccard) of nodes."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _id_key(doc_id).alias("key"), _text_hash(text).alias("h"), F.col(f"`{text}`").alias("text"))
    outputs = [("class", T.BinaryType()), ("value", T.LongType()), ("sketch", T.BinaryType()), ("bands", T.ArrayType(T.LongType())), ("width", T.IntegerType())]
    made = append_columns(base, "text", ["text"], outputs, _prints(ngram, bands)).drop("text")
    made = checkpointed(made)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "key")).alias("first")
    classes = made.groupBy("class").agg(first, *(F.any_value(c).alias(c) for c in ("value", "sketch", "bands", "width")))
    # numbered once, in the table that is written: a number never changes afterwards
    classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))

    keyed = classes.select("node", F.explode("bands").alias("key"))
    leaders = F.array(*(F.min(F.struct(F.xxhash64("node", F.lit(i)), "node"))["node"] for i in range(LEADERS)))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), leaders.alias("leaders")).filter("n > 1")
    sizes = checkpointed(sizes)
    members = checkpointed(keyed.join(sizes.select("key"), "key").select("key", "node"))
    shared = members.select("node").distinct()
    prints = checkpointed(classes.join(shared, "node", "left_semi").select("node", "value", "sketch", "bands", "width", F.col("first.key").alias("key"), F.col("first.h").alias("h")))
    texts = base.select("key", "h", "text").join(prints.select("node", "key", "h"), ["key", "h"]).groupBy("node").agg(F.any_value("text").alias("text"))
    sets = checkpointed(append_columns(texts, "text", ["text"], [("set", T.ArrayType(T.LongType()))], _sets(ngram)).select("node", "set"))

    near = _first_pass(members, sizes, hot).join(prints.select("node", "value", "sketch"), "node").select("key", "cell", "value", "node", "sketch")
    links = checkpointed(_verified(_searched(near, _candidates(min_jaccard)), sets, min_jaccard))
    roots = components(links)
    cells = checkpointed(_second_pass(members, roots, prints.select("node", "width"), 4 * hot))
    if not cells.isEmpty():
        whole = prints.select("node", "value", "sketch", "bands").join(sets, "node")
        more = cells.join(whole, "node").select("key", "cell", "value", "node", "component", "sketch", "bands", "set")
        more = checkpointed(_verified(_searched(more, _decided(min_jaccard)), sets, min_jaccard))
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)
    rooted = classes.select("class", "node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return made.select("doc_id", "h", "class"), rooted, links


def near_duplicate_links(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ngram: int = 5, bands: int = 16, min_jaccard: float = 0.8, hot: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(links, membership): verified pairs (a, b, jaccard) of classes and (doc_id, class_id, group_id) of every row.

    A class's id is the least doc_id of it, a group's that of all its classes. The links connect each group; two
    classes of a group that are linked through others need not be listed as a pair.
    """
    rows, classes, links = _grouped(docs, doc_id, text, ngram, min_jaccard, bands, hot)
    ids = classes.select("node", F.col("first.doc_id").alias("id"))
    named = links.join(ids.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a").join(ids.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b")
    groups = classes.groupBy("root").agg(F.min("first")["doc_id"].alias("group_id"))
    member = classes.join(groups, "root").select("class", F.col("first.doc_id").alias("class_id"), "group_id")
    return named.select(F.col("ia").alias("a"), F.col("ib").alias("b"), "jaccard"), rows.join(member, "class").select("doc_id", "class_id", "group_id")


def near_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ngram: int = 5, bands: int = 16, min_jaccard: float = 0.8, hot: int = 1024) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the one of least id stays (then least text hash)."""
    _, classes, _ = _grouped(docs, doc_id, text, ngram, min_jaccard, bands, hot)
    own_id, own_h, nth = (absent(docs.columns, name) for name in ("near_id", "near_h", "near_nth"))
    kept = classes.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(own_id), F.col("first.h").alias(own_h))
    own = docs.select("*", _id_key(doc_id).alias(own_id), _text_hash(text).alias(own_h))
    # rows that repeat both id and text are copies too; the join has put them together already
    place = F.row_number().over(Window.partitionBy(own_id, own_h).orderBy(own_h))
    joined = own.join(kept.hint("merge"), [own_id, own_h]).withColumn(nth, place)
    return joined.filter(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
