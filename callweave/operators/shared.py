"""Tables that are read several times, written once to the cluster's shared folder; numbers as text."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by ``checkpoint()`` into ``spark.checkpoint.dir``; a folder is made here only for a master within this machine."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())
    return df.checkpoint()


def fixed(x: Column, digits: int, sign: str = "") -> Column:
    """``x`` with so many decimals, rounded from its exact value (halves to even) as C, Python and DuckDB do; below 2^50 / 10^digits.

    ``format_string`` rounds the shortest decimal that stands for a double, so 0.0905, which is a little less, goes up. The two differ
    only where the double is the one nearest to half a step; there the exact remainder is taken from the double in two parts.
    """
    scale = 2 * 10**digits
    size = F.abs(x)
    k = F.floor(size * (scale // 2))
    half = (k * 2 + 1).cast("double")
    high = size * 134217729.0 - (size * 134217729.0 - size)
    rest = (high * scale - half) + (size - high) * scale
    down = (size == half / scale) & ((rest < 0) | ((rest == 0) & (k % 2 == 0)))
    return F.format_string(f"%{sign}.{digits}f", F.when(down, x * (1 - 2.0**-50)).otherwise(x))
