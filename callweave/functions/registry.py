"""Functions of the library for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.match import sequence_ratio
from ..operators.stitch import kept_after_stutter
from ..sources.readers import LINE, SRT_CLOCK


@F.pandas_udf(T.ArrayType(T.StringType()))
def dedupe_stutter(tokens: pd.Series) -> pd.Series:
    """Tokens with immediately repeated phrases said once."""

    def one(words):
        if words is None:
            return None
        keys = ["".join(c for c in (w or "").lower() if c.isascii() and c.isalnum()) for w in words]
        return [words[i] for i in kept_after_stutter(keys)]

    return tokens.map(one)


#: Functions from a text to its rows, for ``inline``: expressions only, so no Python runs and rows stay where their texts are.
ROW_FUNCTIONS = {
    "parse_transcript": rf"""(value STRING) RETURNS ARRAY<STRUCT<line_no: INT, t: BIGINT, label: STRING, text: STRING>>
      RETURN filter(transform(split(value, r'\r?\n'), (line, n) -> CASE WHEN line RLIKE r'{LINE}' THEN named_struct('line_no', n,
        't', bigint(regexp_extract(line, r'{LINE}', 1)) * 3600 + bigint(regexp_extract(line, r'{LINE}', 2)) * 60 + bigint(regexp_extract(line, r'{LINE}', 3)),
        'label', regexp_extract(line, r'{LINE}', 4), 'text', regexp_extract(line, r'{LINE}', 5)) END), row -> row IS NOT NULL)""",
    "parse_srt": rf"""(value STRING) RETURNS ARRAY<STRUCT<block_no: INT, t: DOUBLE, text: STRING>>
      RETURN filter(transform(filter(transform(split(trim(value), r'\n\n'), (block, n) -> named_struct('n', n, 'said', split(regexp_replace(block, r'^\s+|\s+$', ''), r'\n'))),
          b -> size(b.said) >= 3 AND b.said[1] RLIKE r'{SRT_CLOCK}'),
        b -> named_struct('block_no', b.n, 't', double(regexp_extract(b.said[1], r'{SRT_CLOCK}', 1)) * 3600 + double(regexp_extract(b.said[1], r'{SRT_CLOCK}', 2)) * 60
          + double(regexp_extract(b.said[1], r'{SRT_CLOCK}', 3)) + double(regexp_extract(b.said[1], r'{SRT_CLOCK}', 4)) / 1000.0D,
          'text', trim(array_join(slice(b.said, 3, size(b.said)), ' ')))), row -> row.text <> '')""",
}


def register(spark: SparkSession) -> None:
    """Makes ``seq_ratio(a, b)`` and ``dedupe_stutter(tokens)`` known to SQL, and SQL-only helpers.

    ``SELECT id, inline(r) FROM (SELECT id, parse_transcript(value) AS r FROM texts)`` gives the lines of each text, ``parse_srt`` the
    blocks of SRT texts.
    """
    spark.udf.register("seq_ratio", sequence_ratio)
    spark.udf.register("dedupe_stutter", dedupe_stutter)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION clock(t BIGINT) RETURNS STRING RETURN format_string('%d:%02d:%02d', t div 3600, t % 3600 div 60, t % 60)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION decibels(p DOUBLE) RETURNS DOUBLE RETURN CASE WHEN p > 0 THEN 10 * log10(p) WHEN p IS NOT NULL THEN double('-Infinity') END")
    for name, body in ROW_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
