"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of an Arrow function handles at once.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, the session's ``spark.checkpoint.dir``.

    Where that is unset a folder is made here, but only for a master within this machine (tests).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def absent(taken: Iterable[str], name: str) -> str:
    """``name``, or the first longer form of it that is none of the names taken (in any case)."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def numbered(rows: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """``rows`` with ``number`` (from 0 in their group, by ``order``), ``total`` (rows of the group) and ``part``.

    ``order`` has to tell rows apart and ``group`` holds no nulls. The rows are dealt by range and each range is numbered by
    itself, so neither a group nor the whole table is ever one task; ``part`` is the range. Columns of those names must not be there yet.
    """
    group = group or []
    spread = checkpointed(rows.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id()))
    of_group = Window.partitionBy(*group)
    before = F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = spread.groupBy(*group, "part").agg(F.count("*").alias("n"))
    counts = counts.select(*group, "part", F.coalesce(before, F.lit(0).cast("long")).alias("before"), F.sum("n").over(of_group).alias("total"))
    own = F.row_number().over(Window.partitionBy(*group, "part").orderBy(*order))
    placed = spread.withColumn("own", own).join(counts, [*group, "part"])
    return placed.select(*rows.columns, "part", (F.col("before") + F.col("own") - 1).alias("number"), "total")


def steps(batch: pa.RecordBatch, sizes: list[int], limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts take about ``limit`` bytes; a longer single row is a slice."""
    begin = total = 0
    for row, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(begin, row - begin)
            begin, total = row, 0
        total += size
    if begin < batch.num_rows:
        yield batch.slice(begin)


def text_sizes(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def append_columns(
    df: DataFrame,
    text: str,
    inputs: list[str],
    outputs: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[..., list]],
) -> DataFrame:
    """``df`` with columns made by an Arrow function; a column of the same name is replaced.

    ``make`` is called once in each task and returns a function from the Arrow arrays of ``inputs``
    to the arrays of ``outputs``; the rows are handed over in slices of bounded text size.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [name for name, _ in outputs]
    fields = [f for f in df.schema.fields if f.name not in names or f.name in inputs]
    drop = [f.name for f in fields if f.name in names]
    schema = T.StructType([*(f for f in fields if f.name not in drop), *(T.StructField(n, t) for n, t in outputs)])
    kinds = list(to_arrow_schema(schema).types)
    at = [f.name for f in fields]
    kept = [i for i, n in enumerate(at) if n not in drop]
    where = [at.index(name) for name in inputs]
    of_text = at.index(text)

    def run(batches):
        function = make()
        for batch in batches:
            for part in steps(batch, text_sizes(batch.column(of_text))):
                made = function(*(part.column(i) for i in where))
                columns = [*(part.column(i) for i in kept), *made]
                columns = [
                    c if isinstance(c, pa.Array) and c.type == k else pa.array(c, k) if not isinstance(c, pa.Array) else c.cast(k)
                    for c, k in zip(columns, kinds, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*(F.col(f"`{n}`") for n in at)).mapInArrow(run, schema)
