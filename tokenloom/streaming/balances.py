"""Balance intervals kept up to date from a growing ledger.

A store is a folder of versions. Version n has the intervals that ended in its
step (``closed``), one row a holder for the balance it has now (``open``), and
the holders whose earlier intervals it replaces (``replaced``). A row in
``commits`` is written last and makes the version count: a step that died before
it is simply done again.

``advance`` reads the open rows and the ledger's new days, nothing older, so a
step costs what is new and one row a holder. ``correct`` takes changes of days
already done and rewrites the intervals of the holders they touch only.
``compact`` puts all closed intervals into one version.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.frames import stack

HOLDER = ("token", "holder")
COMMIT_SCHEMA = "version int, base int, day date, scale int"


class Commit(NamedTuple):
    version: int
    base: int  # closed intervals of earlier versions no longer count
    day: object  # all days up to this one are in
    scale: int  # digits after the point that balances keep

    @property
    def amount(self) -> str:
        return f"decimal(38,{self.scale})"


def create(spark: SparkSession, path: str, scale: int = 18) -> None:
    _commit(spark, path, Commit(0, 1, None, scale))


def _commit(spark: SparkSession, path: str, commit: Commit) -> None:
    spark.createDataFrame([commit], COMMIT_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def last_commit(spark: SparkSession, path: str) -> Commit:
    rows = spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/commits")  # one row a step
    return Commit(*rows.orderBy(F.desc("version")).first())


def _schema(amount: str) -> str:
    return f"token string, holder string, day date, next_day date, balance {amount}, v int, kind string"


def _stored(spark: SparkSession, path: str, first: int, last: int, kind: str, amount: str) -> DataFrame:
    """Rows of one kind of the versions first to last; the folders of other kinds are not read."""
    if last < first:
        return spark.createDataFrame([], _schema(amount)).drop("kind")
    folders = [f"{path}/v={v}" for v in range(first, last + 1)]
    return spark.read.option("basePath", path).schema(_schema(amount)).parquet(*folders).where(F.col("kind") == kind).drop("kind")


def _steps(changes: DataFrame, amount: str) -> DataFrame:
    """Intervals of balances from changes per holder and day; the last one of a holder has no end."""
    w = Window.partitionBy(*HOLDER).orderBy("day")
    daily = changes.groupBy(*HOLDER, "day").agg(F.sum("change").alias("change"))
    return daily.select(
        *HOLDER, "day", F.lead("day").over(w).alias("next_day"), F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast(amount).alias("balance")
    )


def _write(rows: DataFrame, path: str, version: int) -> None:
    rows.write.partitionBy("kind").mode("overwrite").parquet(f"{path}/v={version}")


def _marked(steps: DataFrame) -> DataFrame:
    return steps.withColumn("kind", F.when(F.col("next_day").isNull(), "open").otherwise("closed"))


def advance(changes: DataFrame, path: str, as_of: str) -> Commit:
    """Take in the changes (token, holder, day, change) after the last committed day, up to ``as_of``."""
    spark = changes.sparkSession
    now = last_commit(spark, path)
    new = changes.where(F.col("day") <= F.lit(as_of).cast("date"))
    if now.day is not None:
        new = new.where(F.col("day") > F.lit(now.day))
    rows = new.select(*HOLDER, "day", F.col("change").cast(now.amount).alias("change"))
    if now.version:
        opening = _stored(spark, path, now.version, now.version, "open", now.amount)
        rows = stack(rows, opening.select(*HOLDER, "day", F.col("balance").cast(now.amount).alias("change")))
    _write(_marked(_steps(rows, now.amount)), path, now.version + 1)
    done = now._replace(version=now.version + 1, day=spark.sql(f"select date '{as_of}' as d").first().d)
    _commit(spark, path, done)
    return done


def _closed(spark: SparkSession, path: str, now: Commit) -> DataFrame:
    """Closed intervals that no later version replaced."""
    amount = now.amount
    closed = _stored(spark, path, now.base, now.version, "closed", amount)
    gone = _stored(spark, path, now.base, now.version, "replaced", amount).groupBy(*HOLDER).agg(F.max("v").alias("_by"))
    gone = gone.select(*[F.col(k).alias(f"_{k}") for k in HOLDER], "_by")
    same = (F.col("token") == F.col("_token")) & (F.col("holder") == F.col("_holder")) & (F.col("v") < F.col("_by"))
    return closed.join(gone, same, "left_anti").drop("v")


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """token, holder, day, next_day (exclusive), balance up to the last committed day."""
    now = last_commit(spark, path)
    if not now.version:
        return spark.createDataFrame([], f"token string, holder string, day date, next_day date, balance {now.amount}")
    opened = _stored(spark, path, now.version, now.version, "open", now.amount).drop("v")
    return stack(_closed(spark, path, now), opened.withColumn("next_day", F.date_add(F.lit(now.day), 1)))


def correct(late: DataFrame, path: str) -> Commit:
    """Take in changes of days that were done already; only holders they name are written anew."""
    spark = late.sparkSession
    now = last_commit(spark, path)
    amount = now.amount
    late = late.where(F.col("day") <= F.lit(now.day)).select(*HOLDER, "day", F.col("change").cast(now.amount).alias("change"))
    touched = late.select(*HOLDER).distinct()
    opened = _stored(spark, path, now.version, now.version, "open", amount).drop("v")
    known = stack(_closed(spark, path, now), opened)
    w = Window.partitionBy(*HOLDER).orderBy("day")
    change = F.col("balance") - F.coalesce(F.lag("balance").over(w), F.lit(0))
    before = known.join(touched, list(HOLDER), "left_semi").select(*HOLDER, "day", change.cast(now.amount).alias("change"))
    again = _marked(_steps(stack(before, late), now.amount))
    rest = opened.join(touched, list(HOLDER), "left_anti").withColumn("kind", F.lit("open"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("day", "date"), ("next_day", "date"), ("balance", amount))]
    marks = touched.select(*HOLDER, *nothing, F.lit("replaced").alias("kind"))
    _write(stack(again, rest, marks), path, now.version + 1)
    done = now._replace(version=now.version + 1)
    _commit(spark, path, done)
    return done


def compact(spark: SparkSession, path: str) -> Commit:
    """All closed intervals in one version; older folders are no longer read."""
    now = last_commit(spark, path)
    amount = now.amount
    opened = _stored(spark, path, now.version, now.version, "open", amount).drop("v").withColumn("kind", F.lit("open"))
    _write(stack(_closed(spark, path, now).withColumn("kind", F.lit("closed")), opened), path, now.version + 1)
    done = now._replace(version=now.version + 1, base=now.version + 1)
    _commit(spark, path, done)
    return done
