"""Constant dimension tables. Fixed values, a few rows each, safe to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def seed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Inline constant table with an explicit schema."""
    return spark.createDataFrame(rows, schema)


# symbol, name, kind, inception, venue of the price pool, base asset of the pool
PRODUCTS = [
    ("P0", "Alpha", "simple", "1995-01-01", "v2", "B0"),
    ("P1", "Beta", "simple", "1995-03-01", "v3", "B0"),
    ("P2", "Gamma", "leveraged", "1995-06-01", "v2", "B1"),
    ("P3", "Delta", "leveraged", "1996-01-01", "v3", "B1"),
    ("P4", "Epsilon", "simple", "1996-07-01", "fork", "B0"),
]

# symbol, partner, begin, end, streaming fee per year, issue fee, redeem fee, partner split
FEES = [
    ("P0", "North", "1995-01-01", "1997-12-31", 0.0095, 0.0, 0.0, 0.3),
    ("P0", "North", "1998-01-01", "2099-12-31", 0.0075, 0.0, 0.0, 0.25),
    ("P1", "South", "1995-01-01", "2099-12-31", 0.0095, 0.0, 0.0, 0.4),
    ("P2", "North", "1995-01-01", "1999-06-30", 0.0195, 0.001, 0.001, 0.4),
    ("P2", "North", "1999-07-01", "2099-12-31", 0.0195, 0.0005, 0.001, 0.4),
    ("P3", "East", "1995-01-01", "2099-12-31", 0.0195, 0.001, 0.001, 0.4),
    ("P4", "East", "1995-01-01", "2099-12-31", 0.0025, 0.0, 0.0, 0.0),
]


def products(spark: SparkSession) -> DataFrame:
    df = seed(spark, PRODUCTS, "symbol string, name string, kind string, inception string, venue string, base string")
    return F.broadcast(df.withColumn("inception", F.col("inception").cast("date")))


def fees(spark: SparkSession) -> DataFrame:
    df = seed(
        spark, FEES,
        "symbol string, partner string, begin_date string, end_date string,"
        " streaming_fee double, issue_fee double, redeem_fee double, partner_split double",
    )
    return F.broadcast(df.withColumns({c: F.col(c).cast("date") for c in ("begin_date", "end_date")}))
