"""Bindings of the test tables to the canonical event families.

Two time ranges exist: the ``events`` family (January 2024) and the
``orders`` / ``lineitem`` family (1995-2001). Amounts are decimals, so sums do
not depend on the order of addition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ZERO, pad_zeros

EVENTS_START, EVENTS_AS_OF = "2024-01-01", "2024-01-31"
ORDERS_START, ORDERS_AS_OF = "1995-01-01", "2001-08-01"
MONEY = "decimal(18,2)"


def addr(c: Column | str) -> Column:
    """Eight digits at least; longer ids keep all of theirs."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.lit("0x"), pad_zeros((c + 1).cast("string"), 8))


def ratio4(num: Column, den: Column) -> Column:
    """Quotient of two decimals as decimal with four digits, rounded down."""
    return (F.call_function("div", (num * 1000000).cast("decimal(38,0)"), (den * 100).cast("decimal(38,0)")) * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(18,4)")


class Tables:
    """Canonical views over one data folder; nothing is read until an action."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # -- events family -----------------------------------------------------

    @cached_property
    def ev(self) -> DataFrame:
        """Events with typed columns: day, block order, pool, small integer k."""
        e = self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
        return e.select(
            "event_id",
            "ts",
            F.to_date("ts").alias("day"),
            F.floor(F.col("event_id") / 4).alias("block"),
            F.pmod("event_id", F.lit(4)).cast("int").alias("idx"),
            F.concat(F.lit("t"), F.floor(F.col("event_id") / 8).cast("string")).alias("tx_hash"),
            "user_id",
            addr("user_id").alias("address"),
            F.concat(F.lit("P"), F.pmod("user_id", F.lit(5)).cast("string")).alias("pool"),
            "event_type",
            F.col("value").cast(MONEY).alias("value"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def transfers(self) -> DataFrame:
        other = addr(F.pmod(F.col("event_id") * 7, F.col("user_id") + 1))  # any user up to the sender, so receivers grow with the users
        et = F.col("event_type")
        return self.ev.select(
            "event_id", "ts", "day", "block", "idx", "tx_hash",
            F.concat(F.lit("P"), F.pmod("event_id", F.lit(5)).cast("string")).alias("token"),
            F.when(et == "signup", F.lit(ZERO)).otherwise(F.col("address")).alias("from_addr"),
            F.when(et == "error", F.lit(ZERO)).when(et == "signup", F.col("address")).otherwise(other).alias("to_addr"),
            "value",
        )

    @cached_property
    def event_prices(self) -> DataFrame:
        """Daily price per symbol in the events family."""
        return self.ev.groupBy(F.col("pool").alias("symbol"), "day").agg(
            ratio4(F.sum("value"), F.count(F.lit(1))).alias("price")
        )

    @cached_property
    def ev_issuance(self) -> DataFrame:
        """Issue and redeem events of the events family, with the module's use type."""
        kind = F.when(F.col("event_type") == "error", F.lit("Redeem")).otherwise(F.lit("Issue"))
        rows = self.of_type("purchase", "signup", "error")
        return rows.select("ts", "day", "tx_hash", F.col("pool").alias("symbol"), F.col("address").alias("wallet"), F.col("value").alias("amount"), kind.alias("evt_type"))

    @cached_property
    def swaps(self) -> DataFrame:
        """Pool swaps: ``value`` of the product against ``k`` of the base asset."""
        return self.of_type("view", "click").select(
            "event_id", "ts", "day", "block", "idx", "tx_hash", "pool", "address", "event_type",
            F.date_trunc("hour", "ts").alias("hour"), F.col("value").alias("amount0"), F.col("k").alias("amount1"),
        )

    @cached_property
    def base_minutes(self) -> DataFrame:
        """Minute prices of two base assets."""
        sym = F.when(F.col("event_type") == "signup", F.lit("B0")).otherwise(F.lit("B1"))
        return self.of_type("signup", "purchase").select(sym.alias("symbol"), F.date_trunc("minute", "ts").alias("minute"), F.col("value").alias("price"))

    def of_type(self, *types: str) -> DataFrame:
        return self.ev.where(F.col("event_type").isin(*types))

    # -- orders family -----------------------------------------------------

    @cached_property
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            "o_orderkey", "o_custkey", "o_orderstatus",
            (F.col("o_totalprice").cast(MONEY) * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(18,5)").alias("amount"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.to_date("o_orderdate").alias("day"),
            F.concat(F.lit("P"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("string")).alias("symbol"),
            F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("tx_hash"),
            addr("o_custkey").alias("wallet"),
        )

    @cached_property
    def issued(self) -> DataFrame:
        return self.orders.where(F.col("o_orderstatus") != "O").select("ts", "day", "tx_hash", "symbol", "wallet", "amount")

    @cached_property
    def redeemed(self) -> DataFrame:
        return self.orders.where(F.col("o_orderstatus") == "O").select("ts", "day", "tx_hash", "symbol", "wallet", "amount")

    @cached_property
    def moves(self) -> DataFrame:
        """Issued and redeemed amounts in one scan, the kind as a column."""
        kind = F.when(F.col("o_orderstatus") == "O", F.lit("Redeem")).otherwise(F.lit("Issue"))
        return self.orders.select("ts", "day", "tx_hash", "symbol", "wallet", "amount", kind.alias("evt_type"))

    @cached_property
    def exchange_txs(self) -> DataFrame:
        """Exchange events; one transaction can have several."""
        li = self.raw("lineitem").where(F.col("l_returnflag") == "R")
        return li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("tx_hash"))

    @cached_property
    def order_ledger(self) -> DataFrame:
        st = F.col("o_orderstatus")
        other = addr(F.pmod(F.col("o_orderkey") * 3, F.col("o_custkey") + 1))
        return self.orders.select(
            "ts", "day", F.col("o_orderkey").alias("block"), F.lit(0).alias("idx"), "tx_hash", F.col("symbol").alias("token"),
            F.when(st == "F", F.lit(ZERO)).otherwise(F.col("wallet")).alias("from_addr"),
            F.when(st == "O", F.lit(ZERO)).when(st == "F", F.col("wallet")).otherwise(other).alias("to_addr"),
            F.col("amount").alias("value"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        li = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
            F.col("l_quantity").cast(MONEY).alias("qty"),
            F.col("l_extendedprice").cast(MONEY).alias("paid"),
            F.to_date("l_shipdate").alias("day"),
        )
        brand = F.substring("p_brand", 7, 4).cast("int")
        pt = self.raw("part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.concat(F.lit("P"), F.pmod(brand, F.lit(5)).cast("string")).alias("symbol"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("kind"),
        )
        return li.join(pt, "l_partkey")

    @cached_property
    def prices(self) -> DataFrame:
        """Daily price per symbol: value over quantity of the day."""
        return self.lines.groupBy("symbol", "day").agg(
            ratio4(F.sum("paid"), F.sum("qty")).alias("price")
        )

    @cached_property
    def trades(self) -> DataFrame:
        """Two-sided trades: the product is on side a or b, the base on the other."""
        base = F.concat(F.lit("B"), F.pmod("l_linenumber", F.lit(3)).cast("string"))
        on_a = F.pmod("l_suppkey", F.lit(2)) == 0

        def pick(a: Column, b: Column) -> Column:
            return F.when(on_a, a).otherwise(b)

        return self.lines.select(
            F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("tx_hash"),
            F.concat_ws("-", "l_partkey", "l_suppkey", "qty", "paid").alias("trace"),
            F.col("l_linenumber").alias("evt_index"),
            "day",
            F.col("day").cast("timestamp").alias("minute"),
            pick(F.col("symbol"), base).alias("token_a"),
            pick(F.col("qty"), F.col("paid")).alias("amount_a"),
            pick(base, F.col("symbol")).alias("token_b"),
            pick(F.col("paid"), F.col("qty")).alias("amount_b"),
        )

    @cached_property
    def base_prices(self) -> DataFrame:
        """Price of the three base assets per minute (here: midnight of each order day)."""
        per = self.orders.groupBy("day").agg(
            ratio4(F.sum("amount"), F.count(F.lit(1))).alias("B0"),
            ratio4(F.max("amount"), F.lit(100)).alias("B1"),
            F.lit(1).cast("decimal(18,4)").alias("B2"),
        )
        return per.unpivot(["day"], ["B0", "B1", "B2"], "symbol", "price").select(
            F.col("day").cast("timestamp").alias("minute"), "symbol", "price"
        )

    # -- dimensions --------------------------------------------------------

    @cached_property
    def holders(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(addr("c_custkey").alias("address"), F.col("c_acctbal").cast(MONEY).alias("balance")).where("balance > 0")

    @cached_property
    def labels(self) -> DataFrame:
        c = self.raw("customer")
        kind = F.when(F.col("c_nationkey") < 3, F.lit("contract")).otherwise(F.lit("owner"))
        return c.select(addr("c_custkey").alias("address"), kind.alias("type"), F.col("c_mktsegment").alias("name"))
