"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, runs of ``ngram`` words
(repeats included) joined by one space, XXH64 with seed 42 of each; a bit is 1 if it is set in over half
of the hashes. A text of fewer words is one run; a text without words (or null) has fingerprint zero.

Links: distinct fingerprints at ``max_bits`` or fewer differing bits. The fingerprint is cut into
``blocks`` blocks; two linked ones agree on at least ``blocks - max_bits`` of them, so all pairs meet
under some choice of that many blocks (pigeonhole: no link is lost). Within such a bucket the
fingerprints are sorted by Gray rank; consecutive ones make the leaves of a tree whose nodes hold the
bits that all below share. A pair of nodes is pruned when their shared bits differ too often or when
both belong to one component already, and joined as a whole when all bits that may differ are few enough. Each bucket
yields a spanning forest of its links, never all pairs. Buckets of over ``hot`` fingerprints are dealt
again by blocks of the bits they do not share, by the same rule and as often as it takes: after five times no more than
sixteen bits are left, so no bucket can hold more than 65,536 distinct ones. Components are found by large-star / small-star
rounds over a checkpointed edge table.

``near_dedup`` keeps one document of each group of near copies; see ``nearcopies``, which uses this index within
bands and decides by the exact similarity of shingle sets.

Repeated fingerprints count once. Rows with a null id get a component like any other; a component of
only null ids has a null component id.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpointed

FAN = 8


# ---------------------------------------------------------------- fingerprints


def _votes(hashes: list[bytes]) -> bytes:
    """A bit is set if it is set in over half of the hashes."""
    rows = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(rows), 1 << 14):
        counts += np.unpackbits(rows[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(rows)).tobytes()


def _runs(words: list[bytes], ngram: int):
    if len(words) <= ngram:
        return [b" ".join(words)]
    return map(b" ".join, zip(*(words[i:] for i in range(ngram)), strict=False))


def _maker(ngram: int):
    def make():
        import xxhash

        digest = xxhash.xxh64_digest

        def one(text) -> int:
            words = text.encode().lower().split() if text else []
            bits = _votes([digest(x, 42) for x in _runs(words, ngram)]) if words else bytes(8)
            return int.from_bytes(bits, "big", signed=True)

        def function(texts):
            return [pa.array([one(x) for x in texts.to_pylist()], pa.int64())]

        return function

    return make


def fingerprints(docs: DataFrame, *, text: str = "text", ngram: int = 3, output: str = "fingerprint") -> DataFrame:
    """``docs`` with the 64-bit fingerprint as a (signed) long."""
    return append_columns(docs, text, [text], [(output, T.LongType())], _maker(ngram))


def hex_fingerprint(column):
    """16 lowercase hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


# ---------------------------------------------------------------- links in a bucket


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray code order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the pairs in ``parent`` (roots in, roots out); returns positions of the pairs that joined two trees."""
    used = []
    at = np.arange(len(a))
    while len(at):
        x, y = parent[a[at]], parent[b[at]]
        apart = x != y
        at, x, y = at[apart], x[apart], y[apart]
        if not len(at):
            break
        low, high = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((low, high))
        first = np.ones(len(order), bool)
        first[1:] = high[order][1:] != high[order][:-1]
        chosen = order[first]
        parent[high[chosen]] = low[chosen]
        used.append(at[chosen])
        parent = _roots(parent)
    return parent, np.concatenate(used) if used else np.empty(0, np.int64)


class GrayTree:
    """The hierarchical index over buckets of fingerprints in Gray order."""

    def __init__(self, bucket: np.ndarray, values: np.ndarray, accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        """``bucket``: non-decreasing numbers; ``values``: uint64 in Gray order within each bucket.

        A link of few enough differing bits also needs the consent of ``accept``, if that is given.
        """
        self.accept = accept
        self.bucket, self.values = [bucket], values
        self.all, self.any = [values], [values]
        self.begin: list[np.ndarray] = []
        while True:
            b = self.bucket[-1]
            starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            sizes = np.diff(np.append(starts, len(b)))
            if sizes.max() == 1:
                break
            place = np.arange(len(b)) - np.repeat(starts, sizes)
            begin = np.flatnonzero(place % FAN == 0)
            self.begin.append(np.append(begin, len(b)))
            self.bucket.append(b[begin])
            self.all.append(np.bitwise_and.reduceat(self.all[-1], begin))
            self.any.append(np.bitwise_or.reduceat(self.any[-1], begin))

    def _expand(self, level: int, a: np.ndarray, b: np.ndarray):
        """Pairs of the children of node pairs of ``level``; a node with itself gives each pair once."""
        begin = self.begin[level - 1]
        i, j = np.divmod(np.arange(FAN * FAN), FAN)
        x, y = begin[a][:, None] + i, begin[b][:, None] + j
        good = (x < begin[a + 1][:, None]) & (y < begin[b + 1][:, None]) & ((a != b)[:, None] | (x <= y))
        return x[good], y[good]

    def near(self, a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
        good = np.bitwise_count(self.values[a] ^ self.values[b]) <= max_bits
        if self.accept and good.any():
            at = np.flatnonzero(good)
            good[at] = self.accept(a[at], b[at])
        return good

    def forest(self, max_bits: int, component: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions of pairs: a spanning forest of the links at ``max_bits`` or fewer, between components if these are given."""
        n = len(self.values)
        self.parent = np.arange(n)
        if component is not None:
            _, first, which = np.unique(component, return_index=True, return_inverse=True)
            self.parent = first[which]
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def join(a, b):
            self.parent, used = _union(self.parent, a, b)
            if len(used):
                out.append((a[used], b[used]))

        # neighbours in Gray order first: they collapse groups of close copies, which prunes most else
        for step in (1, 2):
            a = np.flatnonzero((self.bucket[0][:-step] == self.bucket[0][step:]) & (self.parent[:-step] != self.parent[step:])) if n > step else np.empty(0, np.int64)
            a = a[self.near(a, a + step, max_bits)]
            join(a, a + step)
        self._descend(max_bits, join, whole=self.accept is None)
        return _joined(out)

    def _descend(self, max_bits: int, take: Callable, whole: bool, chunk: int = 1 << 15) -> None:
        """Hands over the near pairs of leaves of different components, from the roots of the trees downwards."""
        roots = np.arange(len(self.bucket[-1]))
        stack = [(len(self.begin), roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                apart = self.parent[a] != self.parent[b]
                a, b = a[apart], b[apart]
                near = self.near(a, b, max_bits)
                take(a[near], b[near])
                continue
            if len(a) > chunk:
                stack += [(level, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)]
                continue
            x, y = self._expand(level, a, b)
            level -= 1
            shared = ~(self.all[level] ^ self.any[level])
            apart = np.bitwise_count((self.all[level][x] ^ self.all[level][y]) & shared[x] & shared[y])
            x, y = x[apart <= max_bits], y[apart <= max_bits]
            if level:
                lowest, highest = self._span(self.parent, level)
                same = (lowest[x] == highest[x]) & (lowest[y] == highest[y]) & (lowest[x] == lowest[y])
                x, y = x[~same], y[~same]
                if whole:
                    free = np.bitwise_count((self.any[level][x] | self.any[level][y]) & ~(self.all[level][x] & self.all[level][y]))
                    if (free <= max_bits).any():
                        take(*self._star(level, x[free <= max_bits], y[free <= max_bits]))
                        x, y = x[free > max_bits], y[free > max_bits]
            if len(x):
                stack.append((level, x, y))

    def _span(self, parent: np.ndarray, level: int):
        low = high = parent
        for begin in self.begin[:level]:
            low, high = np.minimum.reduceat(low, begin[:-1]), np.maximum.reduceat(high, begin[:-1])
        return low, high

    def _leaves(self, level: int, node: np.ndarray):
        begin, end = node, node + 1
        for marks in reversed(self.begin[:level]):
            begin, end = marks[begin], marks[end]
        return begin, end

    def _star(self, level: int, x: np.ndarray, y: np.ndarray):
        """All leaves of x and of y to the first leaf of x: any two below differ in few enough bits."""
        ends = []
        centre, _ = self._leaves(level, x)
        for node in (x, y):
            begin, end = self._leaves(level, node)
            count = end - begin
            leaf = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            ends.append((np.repeat(centre, count), leaf))
        a, b = (np.concatenate(z) for z in zip(*ends, strict=True))
        return a[a != b], b[a != b]


def _joined(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


def bucket_rows(pairs: Callable, value_at: int = 2, limit: int = 1 << 16) -> Callable:
    """An Arrow function from rows (two columns that name the bucket, value, node ...), buckets together, to edges (a, b).

    ``pairs`` gets whole buckets of two rows or more, each in the Gray order of its values, and returns two arrays of nodes.
    """

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = [np.asarray(c) for c in batch.columns]
                held = new if held is None else [np.concatenate(z) for z in zip(held, new, strict=True)]
                if len(held[0]) < limit:
                    continue
            if held is None or not len(held[0]):
                continue
            first, second = held[:2]
            cut = len(first)
            if batch is not None:  # the last bucket may go on in the next batch
                last = np.flatnonzero((first != first[-1]) | (second != second[-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
            if not cut:
                continue
            now, held = [z[:cut] for z in held], [z[cut:] for z in held]
            order = np.lexsort((gray_rank(now[value_at].view(np.uint64)), now[1], now[0]))
            now = [z[order] for z in now]
            edge = np.concatenate([[True], (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])])
            many = np.bincount(np.cumsum(edge) - 1)[np.cumsum(edge) - 1] > 1
            if many.any():
                a, b = pairs(*(z[many] for z in now))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _bucket_links(max_bits: int):
    def pairs(combo, block, value, node):
        bucket = np.cumsum(np.concatenate([[0], (combo[1:] != combo[:-1]) | (block[1:] != block[:-1])]))
        a, b = GrayTree(bucket, value.view(np.uint64)).forest(max_bits)
        return node[a], node[b]

    return bucket_rows(pairs)


def _masks(bits: list[int], blocks: int, choose: int) -> list[int]:
    """Masks of every choice of ``choose`` out of ``blocks`` runs of the given bit positions."""
    parts = [int(sum(1 << int(b) for b in part)) for part in np.array_split(np.array(bits), blocks)]
    return [sum(c) for c in itertools.combinations(parts, choose)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, plan: dict[int, list[tuple[int, int]]]) -> DataFrame:
    """A row for each (combo, mask) that ``plan`` gives for the row's combo: (combo, block, value, node)."""
    table = [(now, combo, _signed(mask)) for now, more in plan.items() for combo, mask in more]
    # no more rows than there are choices of blocks at this depth
    masks = F.broadcast(rows.sparkSession.createDataFrame(table, "combo long, next long, mask long"))
    return rows.join(masks, "combo").select(F.col("next").alias("combo"), F.col("value").bitwiseAND(F.col("mask")).alias("block"), "value", "node")


def links(values: DataFrame, *, max_bits: int = 3, blocks: int = 4, choose: int | None = None, hot: int = 4096, deepest: int = 5) -> DataFrame:
    """Edges (a, b) of nodes: their components are those of all links.

    ``values``: distinct rows (value[, node]); without ``node`` the value itself is the node.
    """
    choose = choose or blocks - max_bits
    if choose > blocks - max_bits:
        raise ValueError("a choice of more blocks than always agree loses links")
    node = F.col("node") if "node" in values.columns else F.col("value")
    now = values.select(F.lit(0).cast("long").alias("combo"), "value", node.alias("node"))
    fixed, ready = {0: 0}, None
    for depth in range(deepest + 1):
        plan, masks = {}, {}
        for combo, mask in fixed.items():
            rest = [b for b in range(64) if not mask >> b & 1]
            inner = [m | mask for m in _masks(rest, blocks, choose)]
            plan[combo] = [(combo * len(inner) + i, m) for i, m in enumerate(inner)]
            masks |= dict(plan[combo])
        now, fixed = _dealt(now, plan), masks
        if depth == deepest:
            ready = _with(ready, now, depth)
            break
        sizes = checkpointed(now.groupBy("combo", "block").count().filter(F.col("count") > hot).select("combo", "block", F.lit(1).alias("is_hot")))
        if sizes.isEmpty():
            ready = _with(ready, now, depth)
            break
        marked = now.join(sizes, ["combo", "block"], "left")
        ready = _with(ready, marked.filter("is_hot is null"), depth)
        now = checkpointed(marked.filter("is_hot is not null").select("combo", "value", "node"))
    edges = ready.repartition("depth", "combo", "block").sortWithinPartitions("combo", "block").select("combo", "block", "value", "node")
    return edges.mapInArrow(_bucket_links(max_bits), "a long, b long").distinct()


def _with(ready: DataFrame | None, more: DataFrame, depth: int) -> DataFrame:
    # buckets of different depths stay apart
    more = more.select(F.lit(depth).alias("depth"), (F.col("combo") + (depth << 40)).alias("combo"), "block", "value", "node")
    return more if ready is None else ready.unionByName(more)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node of its component.

    Alternating large-star and small-star rounds; each round's edges are checkpointed, so no round
    depends on the state of executors.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def signature(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    old = signature(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = checkpointed(small.select("e.u", "e.v").filter("u <> v").distinct())
        new = signature(now)
        if new == old:
            break
        old = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ngram: int = 3, max_bits: int = 3, blocks: int = 4, hot: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id): the least id reachable over links, itself included."""
    prints = checkpointed(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ngram=ngram).select("doc_id", "fingerprint"))
    groups = checkpointed(prints.groupBy(F.col("fingerprint").alias("value")).agg(F.min("doc_id").alias("least")))
    found = components(links(groups.select("value"), max_bits=max_bits, blocks=blocks, hot=hot))
    rooted = groups.join(found, groups["value"] == found["node"], "left").select("value", "least", F.coalesce("root", "value").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = rooted.join(ids, "root").select("value", "component_id")
    return prints.join(table, prints["fingerprint"] == table["value"], "left").select("doc_id", "fingerprint", "component_id")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near copies (see ``nearcopies.near_dedup`` for the options)."""
    from . import nearcopies

    return nearcopies.near_dedup(docs, **options)
