"""Files under the recordings' own names, written anew or in place."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How Spark names the folder of a null partition value.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def write_named(texts: DataFrame, folder: str, *, name: str = "name", text: str = "text") -> int:
    """One file for each row, called ``name`` (which may have folders) inside ``folder``; returns how many.

    Spark writes all texts into a staging folder by its own commit protocol, which outlives lost executors. Only when that job is
    done are the files renamed, each over an older one of its name. So a job that fails leaves all files as they were, and a job may
    write over the files that it reads. Null names, names that lead out of the folder, and rows that share a name raise ValueError
    before any rename. A null text is an empty one; each file ends with one line break. Only names pass through the driver.
    """
    spark = texts.sparkSession
    hadoop, unescape = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    conf = spark._jsc.hadoopConfiguration()
    fs = hadoop.Path(folder).getFileSystem(conf)
    base = fs.makeQualified(hadoop.Path(folder))
    staging = hadoop.Path(base, f".staging-{uuid.uuid4().hex}")
    body = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n\z", "")
    try:
        texts.select(F.col(name).alias("name"), body.alias("text")).write.partitionBy("name").text(staging.toString())
        moves: dict[str, object] = {}
        listed = fs.listFiles(staging, True)
        while listed.hasNext():
            path = listed.next().getPath()
            place = path.getParent().getName()
            if not place.startswith("name="):
                continue
            wanted = unescape(place[len("name=") :])
            if wanted == NULL_FOLDER or wanted.startswith("/") or ".." in wanted.split("/"):
                raise ValueError(f"no file name: {wanted}")
            if wanted in moves:
                raise ValueError(f"several texts have the name {wanted}")
            moves[wanted] = path
        context = hadoop.FileContext.getFileContext(base.toUri(), conf)
        rename = getattr(hadoop, "Options$Rename")
        over = spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        for wanted, path in moves.items():
            target = hadoop.Path(base, wanted)
            fs.mkdirs(target.getParent())
            context.rename(path, target, over)
        return len(moves)
    finally:
        fs.delete(staging, True)
