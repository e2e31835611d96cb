"""State that is kept from run to run: balance intervals and daily sums."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import ledger as L
from tokenloom.streaming import balances as Z
from tokenloom.streaming import daily as D


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def changes(spark, seed=1, n=900):
    rng = random.Random(seed)
    rows = [("t", "hot" if rng.random() < 0.4 else f"h{rng.randrange(30)}", day(rng.randrange(30)), rng.randrange(-50, 100)) for _ in range(n)]
    df = spark.createDataFrame(rows, "token string, holder string, day date, change bigint")
    return df.groupBy("token", "holder", "day").agg(F.sum("change").cast("decimal(18,5)").alias("change"))


def rows(df):
    return sorted((r.token, r.holder, r.day, r.next_day, r.balance) for r in df.collect())


def test_two_steps_equal_one_and_read_only_new_days(spark, tmp_path):
    change = changes(spark)
    store, ledger = str(tmp_path / "store"), str(tmp_path / "ledger")
    Z.create(spark, store)
    assert rows(Z.intervals(spark, store)) == []
    change.where(F.col("day") <= day(12)).write.parquet(f"{ledger}-a")
    Z.advance(spark.read.parquet(f"{ledger}-a"), store, "2024-01-13")
    assert rows(Z.intervals(spark, store)) == rows(L.balance_intervals(change, "2024-01-13"))
    # the second step is given the new days only: nothing older exists for it
    change.where(F.col("day") > day(12)).write.parquet(f"{ledger}-b")
    Z.advance(spark.read.parquet(f"{ledger}-b"), store, "2024-01-20")
    Z.advance(spark.read.parquet(f"{ledger}-b"), store, "2024-01-30")
    assert rows(Z.intervals(spark, store)) == rows(L.balance_intervals(change, "2024-01-30"))
    assert Z.last_commit(spark, store)[:2] == (3, 1)


def test_a_step_that_died_is_done_again(spark, tmp_path, monkeypatch):
    change, store = changes(spark, 2), str(tmp_path / "store")
    Z.create(spark, store)
    Z.advance(change, store, "2024-01-10")

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Z, "_commit", die)
        with pytest.raises(RuntimeError):
            Z.advance(change.where(F.col("holder") == "hot"), store, "2024-01-25")
    assert rows(Z.intervals(spark, store)) == rows(L.balance_intervals(change, "2024-01-10"))
    Z.advance(change, store, "2024-01-25")
    assert rows(Z.intervals(spark, store)) == rows(L.balance_intervals(change, "2024-01-25"))


def test_late_changes_rewrite_the_holders_they_name(spark, tmp_path):
    change, store = changes(spark, 3), str(tmp_path / "store")
    late = (F.col("holder").isin("hot", "h3", "h4") & (F.col("day") < day(9))) | (F.col("holder") == "h5")
    Z.create(spark, store)
    Z.advance(change.where(~late), store, "2024-01-15")
    Z.advance(change.where(~late), store, "2024-01-25")
    Z.correct(change.where(late), store)
    due = change.where(~late | (F.col("day") <= day(24)))
    assert rows(Z.intervals(spark, store)) == rows(L.balance_intervals(due, "2024-01-25"))
    replaced = spark.read.parquet(f"{store}/v=3").where("kind = 'replaced'")
    assert {r.holder for r in replaced.collect()} == {"hot", "h3", "h4", "h5"}
    assert {r.holder for r in spark.read.parquet(f"{store}/v=3").where("kind = 'closed'").collect()} <= {"hot", "h3", "h4", "h5"}
    want = rows(Z.intervals(spark, store))
    assert Z.compact(spark, store)[:2] == (4, 4)
    assert rows(Z.intervals(spark, store)) == want
    Z.advance(change, store, "2024-01-30")
    assert rows(Z.intervals(spark, store)) == rows(L.balance_intervals(change, "2024-01-30"))


def test_an_event_later_than_any_watermark_corrects_its_day(spark, tmp_path):
    folder, store, chk = (str(tmp_path / x) for x in ("in", "store", "chk"))

    def add(*rows):
        spark.createDataFrame([(dt.datetime(2024, 1, d, 12), k, v) for d, k, v in rows], "ts timestamp, k string, v bigint").coalesce(1).write.mode("append").parquet(folder)

    def run():
        D.merge_days(D.event_stream(spark, folder, spark.read.parquet(folder)), "ts", ["k"], "v", store, chk)
        return {(r.day.day, r.k): (r.v, r.n) for r in D.merged_days(spark, store, ["k"], "v").collect()}

    add((1, "a", 1), (1, "a", 2), (2, "a", 4), (20, "b", 8))
    assert run() == {(1, "a"): (3, 2), (2, "a"): (4, 1), (20, "b"): (8, 1)}
    add((1, "a", 100), (3, "c", 16), (20, "b", 1))  # day 1 is 19 days older than the newest event
    want = {(1, "a"): (103, 3), (2, "a"): (4, 1), (3, "c"): (16, 1), (20, "b"): (9, 2)}
    assert run() == want
    assert run() == want  # nothing new, nothing counted twice
