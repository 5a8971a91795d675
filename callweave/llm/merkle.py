"""Merkle manifest of a table: a tree for each group of rows, one tree over the groups' roots, a proof for each row.

A row's leaf is the digest of chosen columns. Within a group leaves stand in order; while several nodes remain, each run of
eight consecutive ones (the last may be shorter, even one) becomes the digest of their concatenation. Digests are
lowercase hexadecimal SHA-256 and enter as that text. The groups' roots, in order of the groups (null first, bytewise), are the leaves
of the last tree.

Nodes are made by an associative and commutative monoid, the sparse forest: a fragment holds the nodes whose run is not complete yet,
keyed by tree, level and index. As a tree's number of leaves gives the arity of each run in advance, adding
two fragments closes every run that becomes complete, whatever the order. Each task folds its stretch of leaves
into a fragment of some dozen nodes a level; then fragments that lie side by side are added, sixteen at a time, round after round, each round as
a small table. Nodes that close are kept for the proofs, which are handed down from the roots, run by run.

Nulls in any column are marked in the leaf; rows with a null group are a group, rows with a null place come first in theirs. Rows that
tie are ordered by their leaf, and rows equal in that too are interchangeable. An empty table has no nodes and no root. Long texts are hashed
by Spark and only digests are moved. The caller's columns travel in a struct, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, numbered

ARITY = 8
#: Fragments added together in a round.
FAN = 16
_NODE = "tree string, level int, number long, total long, digest string, made boolean, part int"


def digest_of(*columns: Column) -> Column:
    """The digest of columns: each ``-`` if null, else its length in UTF-8 bytes, a colon and its text."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


class Forest:
    """Nodes that wait for the rest of their run, keyed by tree, level and run."""

    def __init__(self) -> None:
        self.waiting: dict[tuple[str, int, int], dict[int, str]] = {}
        self.totals: dict[str, int] = {}

    def add(self, tree: str, total: int, level: int, number: int, digest: str) -> Iterator[tuple[str, int, int, int, str]]:
        """Adds a node and gives the nodes that close by it."""
        while (width := -(-total // ARITY**level)) > 1:
            run, own = divmod(number, ARITY)
            held = self.waiting.setdefault((tree, level, run), {})
            held[own] = digest
            self.totals[tree] = total
            if len(held) < min(ARITY, width - run * ARITY):
                return
            del self.waiting[tree, level, run]
            digest = hashlib.sha256("".join(held[i] for i in sorted(held)).encode()).hexdigest()
            level, number = level + 1, run
            yield tree, level, number, total, digest

    def nodes(self) -> Iterator[tuple[str, int, int, int, str]]:
        for (tree, level, run), held in self.waiting.items():
            for own, digest in held.items():
                yield tree, level, run * ARITY + own, self.totals[tree], digest


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes, those of a part together, to the nodes that close (made) and those that wait."""

    def rows():
        forest, part = Forest(), None
        for batch in batches:
            for tree, level, number, total, digest, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != part:
                    yield from ((*node, False, part) for node in forest.nodes())
                    forest, part = Forest(), own
                yield from ((*node, True, part) for node in forest.add(tree, total, level, number, digest))
        yield from ((*node, False, part) for node in forest.nodes())

    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32()]
    names = [field.split()[0] for field in _NODE.split(", ")]
    held: list[tuple] = []
    for row in rows():
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def inner_nodes(leaves: DataFrame) -> DataFrame:
    """(tree, level, number, total, digest) of all nodes above the leaves, which are (tree, number, total, digest, part); a part is a stretch of each tree."""
    nodes = leaves.select("tree", F.lit(0).alias("level"), "number", "total", "digest", "part")
    parts = (leaves.agg(F.max("part")).first()[0] or 0) + 1
    made = []
    while True:
        together = nodes.repartition("part").sortWithinPartitions("part", "tree", "level", "number")
        out = checkpointed(together.mapInArrow(_added, _NODE))
        made.append(out.filter("made").drop("made", "part"))
        if parts == 1:
            return reduce(DataFrame.unionByName, made)
        parts = -(-parts // FAN)
        nodes = out.filter("not made").withColumn("part", F.floor(F.col("part") / FAN).cast("int")).drop("made")


#: SQL: the level of the root of a tree of ``total`` leaves.
_HEIGHT = "size(filter(sequence(0, 20), e -> shiftleft(1L, 3 * e) < total))"


def _handed_down(leaves: DataFrame, nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """``leaves`` with ``above`` of their tree in ``tops`` (tree, above, path) and their own ``path``: one (left, right) a level, from the leaf up."""
    largest = leaves.agg(F.max("total")).first()[0] or 0
    height = next(level for level in range(22) if ARITY**level >= largest)
    of_leaf = F.struct("r").alias("own")
    known = None
    for level in range(height, -1, -1):
        here = nodes.filter(F.col("level") == level).select("tree", "number", "total", "digest", F.lit(None).alias("own")) if level else leaves.select("tree", "number", "total", "digest", of_leaf)
        found = here.filter(f"{_HEIGHT} = {level}").join(tops, "tree").select("tree", "number", "digest", "own", "above", "path")
        if known is not None:
            run = F.floor(F.col("number") / ARITY).cast("long")
            kids = F.array_sort(F.collect_list(F.struct("number", "digest", "own")), lambda a, b: (a["number"] - b["number"]).cast("int"))
            runs = here.filter(f"{_HEIGHT} > {level}").groupBy("tree", run.alias("run")).agg(kids.alias("kids"))
            parents = known.select("tree", F.col("number").alias("run"), "above", "path")
            each = runs.join(parents, ["tree", "run"]).select("tree", "above", "path", F.col("kids.digest").alias("digests"), F.posexplode("kids").alias("at", "kid"))
            left = F.array_join(F.slice("digests", F.lit(1), F.col("at")), "")
            right = F.array_join(F.slice("digests", F.col("at") + 2, F.size("digests")), "")
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            below = each.select("tree", "kid.number", "kid.digest", "kid.own", "above", F.concat(step, "path").alias("path"))
            found = found.unionByName(below)
        known = found
    return known.select("tree", "number", "digest", F.col("own.r").alias("r"), "above", "path")


def _roots(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, digest) of each tree's root."""
    whole = leaves.filter("total = 1").select("tree", "digest")
    return whole.unionByName(nodes.filter(f"level = {_HEIGHT}").select("tree", "digest"))


@dataclass(frozen=True)
class Manifest:
    """``root`` (null for an empty table), ``nodes`` (tree, level, number, total, digest) of the groups' trees above the leaves, and ``rows``
    (r, leaf, subroot, path): r has the columns handed over, path a struct (left, right) of siblings for each level up to the root."""

    root: str | None
    nodes: DataFrame
    rows: DataFrame


def build(rows: DataFrame, leaf: Column, *, group: str = "lang", place: str = "doc_id", keep: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``rows``: trees by ``group``, leaves in the order of ``place``; ``keep`` names what ``r`` holds (by default the place)."""
    own = [c.alias(name) for name, c in (keep or {place: F.col(f"`{place}`")}).items()]
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    # written before it is dealt by range, which reads its input twice; a copy's number tells equal rows apart
    base = checkpointed(rows.select(tree.alias("tree"), F.col(f"`{place}`").alias("place"), leaf.alias("digest"), F.monotonically_increasing_id().alias("copy"), F.struct(*own).alias("r")))
    leaves = checkpointed(numbered(base, ["place", "digest", "copy"], ["tree"]))
    nodes = inner_nodes(leaves)
    roots = _roots(leaves, nodes).select(F.lit("").alias("tree"), "digest", F.struct("tree", "digest").alias("r"))
    trees = checkpointed(numbered(roots, ["r"]))
    above = inner_nodes(trees)
    root = _roots(trees, above).first()
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = trees.select("tree").distinct().select("tree", F.lit(None).alias("above"), none.alias("path"))
    tops = _handed_down(trees, above, start).select("r.tree", F.col("r.digest").alias("above"), "path")
    found = _handed_down(leaves, nodes, tops)
    return Manifest(root["digest"] if root else None, nodes, found.select("r", F.col("digest").alias("leaf"), F.col("above").alias("subroot"), "path"))


def proof_digest(path: str = "path") -> Column:
    """The digest of all siblings of a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that follows from a leaf and the siblings of its path."""
    return F.aggregate(path, leaf, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))
