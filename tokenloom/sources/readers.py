"""Readers for event tables, call tables, raw logs, CSV, JSON and text lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import uint256 as U
from ..functions.scalar import hex_to_number, hex_word, norm_address


def read_events(
    spark: SparkSession, path: str, columns: Sequence[str], time: str, start: str | None = None, as_of: str | None = None, **equals
) -> DataFrame:
    """Scan an event table for some contracts and a time range.

    Predicates are on stored columns in their stored type, so they and the
    column list reach the Parquet scan.
    """
    df = spark.read.parquet(path)
    kind = df.schema[time].dataType
    for name, value in equals.items():
        df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast(kind))
    if as_of is not None:
        df = df.where(F.col(time) < F.lit(as_of).cast(kind))
    return df.select(*columns)


def successful_calls(calls: DataFrame, flag: str = "call_success") -> DataFrame:
    return calls.where(F.col(flag))


def decode_logs(logs: DataFrame, topic1: str, words: Mapping[str, tuple[str, int, str]]) -> DataFrame:
    """Rows of one event with named 32-byte words of its topics or data.

    ``words``: name -> (column, word index, kind). Kinds: 'number' (a double),
    'uint256' (exact, see ``functions.uint256``), 'uint256_text' and 'int256_text'
    (all digits), 'address', 'hex'.
    """
    exact = {"uint256": lambda c: c, "uint256_text": U.to_text, "int256_text": U.signed_text}

    def decode(column: str, index: int, kind: str) -> Column:
        word = hex_word(column, index)
        if kind == "number":
            return hex_to_number(word)
        if kind in exact:
            return exact[kind](U.from_hex(word))
        return F.concat(F.lit("0x"), F.substring(word, 25, 40)) if kind == "address" else word

    rest = [c for c in logs.columns if not c.startswith("topic") and c != "data"]
    return logs.where(F.col("topic1") == topic1).select(*rest, *[decode(*spec).alias(n) for n, spec in words.items()])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    """One address per line, quoted or not, of any case."""
    found = F.regexp_extract("value", r"(\\x|0x)[0-9a-fA-F]+", 0)
    return spark.read.text(path).select(norm_address(found).alias("address")).where("address <> ''")


VOTES = "data struct<votes: array<struct<id: string, voter: string, created: bigint, space: struct<id: string>, proposal: struct<id: string>, choice: int, vp: double, vp_by_strategy: array<double>, vp_state: string>>>"
PROPOSALS = "data struct<proposals: array<struct<id: string, created: bigint, title: string, body: string, choices: array<string>, scores: array<double>, scores_total: double, votes: bigint, state: string>>>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def flatten_votes(pages: DataFrame) -> DataFrame:
    """One row per vote of nested result pages."""
    v = pages.select(F.explode("data.votes").alias("v"))
    return v.select(
        F.col("v.id").alias("vote_id"), "v.voter", F.timestamp_seconds("v.created").alias("created"), F.col("v.space.id").alias("space"),
        F.col("v.proposal.id").alias("proposal"), "v.choice", "v.vp", "v.vp_by_strategy", "v.vp_state",
    )


def flatten_proposals(pages: DataFrame) -> DataFrame:
    p = pages.select(F.explode("data.proposals").alias("p"))
    return p.select(
        F.col("p.id").alias("proposal_id"), F.timestamp_seconds("p.created").alias("created"), "p.title", "p.body", "p.choices", "p.scores",
        "p.scores_total", "p.votes", "p.state",
    )
