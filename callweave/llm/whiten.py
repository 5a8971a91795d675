"""Whitening of embeddings by matrix-free block Lanczos.

Entries become whole numbers, ``floor(scale * c) + shift``; the fit list is each distinct vector of them once. Of its
covariance V only products V Q with a block Q of some columns are ever formed: each is one pass over the fit list, in which
a task centres its vectors exactly (n x - S in whole numbers, then one division), adds up c (c Q) and hands on one block
of width x columns numbers; ``treeReduce`` adds the blocks. The driver holds the Krylov basis (width x some hundred numbers, whatever
the number of rows), orthogonalises each new block against all of it twice, replaces directions that break down by random
ones, and takes Ritz pairs until every wanted residual is small or the basis spans the whole space. A basis that grows past
``most_basis`` columns is restarted from its best Ritz vectors. The trace comes from the exact squared deviations.

Vectors that are null, or hold nulls, NaN, infinities or numbers from 2^56 on, are dropped; so are those whose length
is not the most common one of the fit list (ties: the longer). Repeated vectors count once in the fit and are all whitened.
Directions whose variance is under 1e-12 of the largest have no component: equal vectors, a single vector or an
empty table give no components and so no whitened entries. A deviation that no long can hold is null.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import absent, shared_folder

#: Entries from here on do not fit the whole numbers.
LARGEST = float(1 << 56)
#: Share of the largest variance under which a direction has none.
LEAST_SHARE = 1e-12
_SAFE = 1 << 62


def whole_numbers(vector: Column, scale: int, shift: int) -> Column:
    """A vector as an array of longs; null where the vector is dropped."""
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda c: c.isNull() | ~(F.abs(c) < LARGEST))
    return F.when(~bad, F.transform(doubles, lambda c: F.floor(c * F.lit(float(scale))).cast("long") + F.lit(shift).cast("long")))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly: longs, or Python's own numbers where longs could overflow."""
    if _largest(x) * n < _SAFE and _largest(sums) < _SAFE:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def squared(moved: np.ndarray) -> np.ndarray:
    """The sum of squares of each row, exactly."""
    if moved.dtype == object or _largest(moved) ** 2 * moved.shape[1] >= _SAFE:
        moved = moved.astype(object)
    return (moved * moved).sum(axis=1)


def _added(fit: DataFrame, width: int, start: tuple, part: Callable[[np.ndarray], tuple]) -> tuple:
    """The sum over all batches of the tuples that ``part`` makes of the vectors; one small row a task is handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = start
        for batch in batches:
            total = _plus(total, part(_matrix(batch.column(0), width)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["sum"])

    sums = fit.mapInArrow(run, "sum binary").rdd.map(lambda r: pickle.loads(r[0]))
    return sums.treeReduce(_plus, depth=3)


def _plus(a: tuple, b: tuple) -> tuple:
    return tuple(p + q for p, q in zip(a, b, strict=True))


# ---------------------------------------------------------------- Lanczos, on the driver


def extend(candidate: np.ndarray, basis: np.ndarray, rng: np.random.Generator, columns: int) -> np.ndarray:
    """Up to ``columns`` new orthonormal columns, orthogonal to the basis: the candidate's directions first, and where those break down random ones."""
    room = min(columns, basis.shape[0] - basis.shape[1])
    out = np.empty((basis.shape[0], 0))
    for source in (candidate, None):
        for j in range(candidate.shape[1] if source is not None else 4 * room):
            if out.shape[1] == room:
                return out
            v = source[:, j].copy() if source is not None else rng.standard_normal(basis.shape[0])
            size = before = np.linalg.norm(v)
            for _ in range(3):  # full reorthogonalisation, again while much of the vector goes
                v -= basis @ (basis.T @ v)
                v -= out @ (out.T @ v)
                size, last = np.linalg.norm(v), size
                if size > 0.7 * last:
                    break
            if before > 0 and size > 1e-10 * before:
                out = np.hstack([out, (v / size)[:, None]])
    return out


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], width: int, k: int, *, block: int | None = None, tolerance: float = 1e-14, most_basis: int = 512, most_passes: int = 200, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``k`` largest eigenvalues of the symmetric matrix that ``product`` multiplies with.

    Ends when each residual |V u - e u| is at most ``tolerance`` times the largest value, when it has stood still at rounding
    (under 1e-10) for three passes, or when the basis spans the whole space.
    """
    want = min(k, width)
    columns = min(width, block or want + 8)
    most_basis = max(most_basis, 2 * want + 2 * columns)
    rng = np.random.default_rng(seed)
    basis = image = np.empty((width, 0))
    fresh = extend(np.empty((width, 0)), basis, rng, columns)
    best, still = np.inf, 0
    for _ in range(most_passes):
        basis, image = np.hstack([basis, fresh]), np.hstack([image, product(fresh)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = basis @ turn[:, :want]
        residual = np.linalg.norm(image @ turn[:, :want] - vectors * values[:want], axis=0).max()
        scale = max(values[0], 0.0)
        still = 0 if residual < best / 2 else still + 1
        best = min(best, residual)
        if basis.shape[1] == width or residual <= tolerance * scale or (still >= 3 and residual <= 1e-10 * scale):
            return values[:want], vectors / np.linalg.norm(vectors, axis=0)
        candidate = image[:, -fresh.shape[1] :]
        if basis.shape[1] + columns > most_basis:
            kept = turn[:, : want + columns]
            basis, image = basis @ kept, image @ kept
            candidate = (image - basis * values[: kept.shape[1]])[:, :columns]
        fresh = extend(candidate, basis, rng, columns)
    raise RuntimeError(f"no convergence in {most_passes} passes: residual {residual:.3g}, largest value {scale:.3g}")


# ---------------------------------------------------------------- the operator


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: ``components`` has a unit vector in each row, by falling ``eigenvalues``."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float
    scale: int
    shift: int

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]

    def project(self, moved: np.ndarray) -> np.ndarray:
        return (moved.astype(np.float64) / self.n) @ self.components.T / np.sqrt(self.eigenvalues)

    def transform(self, rows: DataFrame, vector: str = "embedding") -> DataFrame:
        """The rows that are not dropped, with ``deviation`` and ``whitened`` (array of doubles); columns of those names are replaced."""
        width = len(self.sums)
        columns = [c for c in rows.columns if c.lower() not in ("deviation", "whitened")]
        x = absent(rows.columns, "x")
        own = rows.withColumn(x, whole_numbers(F.col(f"`{vector}`"), self.scale, self.shift)).filter(F.size(x) == width)
        own = own.select(*(F.col(f"`{c}`") for c in columns), x)
        schema = T.StructType([*own.schema.fields[:-1], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                moved = deviations(_matrix(batch.column(len(columns)), width), model.n, model.sums)
                squares = [s if s < 1 << 63 else None for s in map(int, squared(moved))]
                white = model.project(moved)
                ends = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(white.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(squares, pa.int64()), lists], names=schema.names)

        return own.mapInArrow(run, schema)


def fit(rows: DataFrame, vector: str = "embedding", *, k: int = 16, scale: int = 64, shift: int = 1_000_000, **lanczos) -> Whitening:
    """The whitening of the vectors of ``rows``; the fit list is written once to the shared folder."""
    spark = rows.sparkSession
    listed = rows.select(whole_numbers(F.col(f"`{vector}`"), scale, shift).alias("x")).filter("x is not null")
    path = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    listed.groupBy("x").agg(F.size("x").alias("width")).write.parquet(path)
    written = spark.read.schema("x array<bigint>, width int").parquet(path)
    common = written.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 0
    nothing = Whitening(common["count"] if common else 0, np.zeros(width, object), np.empty((0, width)), np.empty(0), 0.0, 0.0, scale, shift)
    if not width:
        return nothing
    vectors = written.filter(F.col("width") == width).select("x")
    n, sums = _added(vectors, width, (0, np.zeros(width, object)), lambda x: (len(x), x.astype(object).sum(axis=0) if _largest(x) * len(x) >= _SAFE else x.sum(axis=0).astype(object)))
    (squares,) = _added(vectors, width, (0,), lambda x: (sum(map(int, squared(deviations(x, n, sums)))),))
    trace = squares / n**3

    def centred(x: np.ndarray) -> np.ndarray:
        return deviations(x, n, sums).astype(np.float64) / n

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> tuple:
            c = centred(x)
            return (c.T @ (c @ q),)

        return _added(vectors, width, (np.zeros(q.shape),), part)[0] / n

    if not squares:
        return Whitening(n, sums, nothing.components, nothing.eigenvalues, trace, 0.0, scale, shift)
    values, found = block_lanczos(product, width, k, **lanczos)
    found = found[:, values > LEAST_SHARE * values[0]]

    def moments(turn: np.ndarray) -> np.ndarray:
        """The covariance of the vectors turned by ``turn``, around their own mean."""

        def sums_of(x: np.ndarray) -> tuple:
            return (centred(x).dot(turn).sum(axis=0),)

        mean = _added(vectors, width, (np.zeros(turn.shape[1]),), sums_of)[0] / n

        def products(x: np.ndarray) -> tuple:
            p = centred(x) @ turn - mean
            return (p.T @ p,)

        return _added(vectors, width, (np.zeros((turn.shape[1],) * 2),), products)[0] / n

    values = np.diag(moments(found))  # measured along the directions: small ones are exact too
    error = np.abs(moments(found / np.sqrt(values)) - np.eye(len(values))).max()
    return Whitening(n, sums, np.ascontiguousarray(found.T), values, trace, float(error), scale, shift)


def whitened_entries(rows: DataFrame, model: Whitening, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    own = model.transform(rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector")), "vector")
    each = own.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*(F.lit(e) for e in model.explained)).cast("array<double>")
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
