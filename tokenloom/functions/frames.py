"""Whole-frame helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stack(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals to double and integers to bigint, one type per kind of number; no negative zero."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DecimalType, T.FloatType, T.DoubleType)):
            c = (c.cast("double") + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(f.name)
        elif isinstance(f.dataType, T.TimestampNTZType):
            c = c.cast("timestamp").alias(f.name)
        out.append(c)
    return df.select(*out)
