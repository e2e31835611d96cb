"""Voting power, concentration, proposals and votes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ZERO, category_of, dbl, safe_div
from ..functions.frames import stack
from .aggregates import count_if
from .joins import scalar_join
from .ordering import grouped_scan, ordered_scan

BY_SIZE = [("balance", True), ("address", False)]

# fixed values: upper ends of the holder percentile bands, in percent
PERCENTILES = (0.1, 1.0, 10.0, 100.0)


def rank_wallets(balances: DataFrame, nonvoting: DataFrame) -> DataFrame:
    """Rank, share and cumulative share of each voting wallet, largest first."""
    bad = nonvoting.select("address").where(F.col("address").isNotNull()).distinct()
    rows = balances.where((F.col("address") != ZERO) & (F.col("balance") > 0)).join(bad, "address", "left_anti")
    ranked = ordered_scan(rows, BY_SIZE, {"cum_balance": "balance"}, position="wallet_rank", totals={"total": "cum_balance"})
    return ranked.select(
        "address", "balance", "wallet_rank", "total", safe_div("balance", "total").alias("share"), safe_div("cum_balance", "total").alias("cum_share")
    )


def nakamoto(ranked: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Smallest number of wallets that together hold more than the threshold."""
    return ranked.where(F.col("cum_share") > threshold).agg(F.min("wallet_rank").alias("nakamoto"))


def units_per_lp(reserves: DataFrame, lp_total: DataFrame) -> DataFrame:
    """Latest pool reserve over pool tokens in existence; one row.

    reserves: (block, idx, reserve); lp_total: one row (total).
    """
    last = reserves.agg(F.max_by("reserve", F.struct("block", "idx")).alias("_r"))
    return scalar_join(last, lp_total).select(safe_div("_r", "total").alias("per_lp"))


def voting_power(
    wallets: DataFrame, pools: Sequence[tuple[str, DataFrame, DataFrame]], vesting: DataFrame, nonvoting: DataFrame
) -> DataFrame:
    """Votes per address: own units, delegated vesting units and units behind pool tokens.

    ``pools`` lists (name, (address, amount) of held and staked pool tokens,
    one-row units per pool token); ``vesting`` maps vesting_address to
    voting_address. Vesting contracts do not vote themselves.
    """
    zero = F.lit(0.0)
    parts = [wallets.select("address", dbl("balance").alias("own"))]
    for name, held, rate in pools:
        lp = scalar_join(held.groupBy("address").agg(F.sum("amount").alias("a")), rate)
        parts.append(lp.select("address", (dbl("a") * F.col("per_lp")).alias(name)))
    delegated = vesting.join(wallets.select(F.col("address").alias("vesting_address"), "balance"), "vesting_address")
    parts.append(delegated.groupBy(F.col("voting_address").alias("address")).agg(dbl(F.sum("balance")).alias("vesting")))
    names = ["own", "vesting", *[p[0] for p in pools]]
    wide = stack(*[p.select("address", *[(F.col(n) if n in p.columns else zero).alias(n) for n in names]) for p in parts])
    sums = wide.groupBy("address").agg(*[F.sum(n).alias(n) for n in names])
    contracts = vesting.select(F.col("vesting_address").alias("address")).distinct()
    votes = sums.where(F.col("address") != ZERO).join(contracts, "address", "left_anti")
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    flag = nonvoting.select("address").distinct().withColumn("_n", F.lit(True))
    kind = F.when(F.col("_n"), F.lit("Nonvoting")).otherwise(F.lit("Voting"))
    return votes.join(flag, "address", "left").select("address", *names, total.alias("total_votes"), kind.alias("wallet_type"))


def gini(df: DataFrame, value: str, key: str) -> DataFrame:
    """Gini coefficient in closed form from ascending ranks; one row."""
    ranked = ordered_scan(df.select(key, value), [(value, False), (key, False)], position="_i")
    s = ranked.agg(F.count(F.lit(1)).alias("n"), F.sum(value).cast("double").alias("s"), F.sum(dbl("_i") * dbl(value)).alias("ix"))
    return s.select("n", (F.lit(2.0) * F.col("ix") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def lorenz(df: DataFrame, value: str, key: str) -> DataFrame:
    """Points of the Lorenz curve: share of holders against share of the total."""
    ranked = ordered_scan(df.select(key, value), [(value, False), (key, False)], {"_c": value}, position="_i", totals={"_s": "_c"}, count="_n")
    return ranked.select(key, safe_div("_i", "_n").alias("population_share"), safe_div("_c", "_s").alias("value_share"))


def min_voters(holders: DataFrame, quorum: float) -> DataFrame:
    """Fewest holders that exceed the quorum, and fewest when only the smaller ones vote; one row."""
    j = ordered_scan(holders.select("address", "balance"), BY_SIZE, {"_c": "balance"}, position="_r", totals={"_s": "_c"}, count="_n")
    rest = F.col("_s") - F.col("_c")
    return j.agg(
        F.min(F.when(F.col("_c") > quorum, F.col("_r"))).alias("min_voters"),
        (F.max("_n") - F.max(F.when(rest > quorum, F.col("_r") - 1))).alias("min_small_voters"),
    )


def _percentile_band(percentile: Column, bands: Sequence[float]) -> Column:
    out, low = None, 0.0
    for high in bands:
        label = F.lit(f"{low}-{high}%")
        out = F.when(percentile < high, label) if out is None else out.when(percentile < high, label)
        low = high
    return out


def percentile_bands(holders: DataFrame, bands: Sequence[float] = PERCENTILES) -> DataFrame:
    """Percentile band of each holder by descending balance."""
    ranked = ordered_scan(holders.select("address", "balance"), BY_SIZE, {"_c": "balance"}, position="_r", totals={"_s": "_c"}, count="_n")
    j = ranked.withColumn("percentile", (F.col("_r") - 1) / F.col("_n") * 100)
    return j.select("address", "balance", "percentile", (safe_div("_c", "_s") * 100).alias("percent_of_supply"), _percentile_band(F.col("percentile"), bands).alias("band"))


def vote_outcome(votes: DataFrame, holders: DataFrame, quorum: float, threshold: float) -> DataFrame:
    """Result per proposal: votes and voters each way, passed or short by how much.

    votes: (proposal, address, choice, balance); choice 1 is for, 2 against.
    ``rescue_rank`` is the lowest-ranked single holder whose balance would have
    covered the shortfall.
    """
    yes, no = F.col("choice") == 1, F.col("choice") == 2
    zero = F.lit(0)
    per = votes.groupBy("proposal").agg(
        F.coalesce(F.sum(F.when(yes, F.col("balance"))), zero).cast("double").alias("votes_for"), count_if(yes).alias("voters_for"),
        F.coalesce(F.sum(F.when(no, F.col("balance"))), zero).cast("double").alias("votes_against"), count_if(no).alias("voters_against"),
    )
    favor = safe_div("votes_for", F.col("votes_for") + F.col("votes_against"))
    per = per.withColumn("in_favor", favor)
    passed = (F.col("votes_for") > quorum) & (F.col("in_favor") > threshold)
    per = per.withColumns({
        "quorum_reached": F.col("votes_for") > quorum, "succeeded": F.when(passed, 1).otherwise(0),
        "short_by": F.when(passed, F.lit(0.0)).otherwise(F.round(F.lit(quorum) - F.col("votes_for"), 2)),
    })
    ranked = grouped_scan(votes.select("proposal", "address", "balance"), ["proposal"], BY_SIZE, {"_c": "balance"}, position="_r")
    fewest = ranked.where(F.col("_c") > quorum).groupBy("proposal").agg(F.min("_r").alias("min_voters"))
    # how many holders are above each shortfall: one sorted pass over holders and shortfalls together
    marks = per.where("succeeded = 0").select(F.col("short_by").alias("balance"), F.col("proposal").alias("address"), F.lit(0).alias("_h"))
    both = stack(holders.select(dbl("balance").alias("balance"), "address", F.lit(1).alias("_h")), marks)
    pos = ordered_scan(both, [("balance", True), ("_h", False), ("address", False)], {"_k": "_h"}, position="_p").where("_h = 0")
    rescue = pos.select(F.col("address").alias("proposal"), F.col("_k").alias("rescue_rank"))
    j = per.join(fewest, "proposal", "left").join(rescue, "proposal", "left")
    rank = F.when(F.col("rescue_rank") > 0, F.col("rescue_rank"))
    return j.withColumns({"min_voters": F.when(F.col("succeeded") == 1, F.col("min_voters")), "rescue_rank": rank})


def turnout(votes: DataFrame, bands: DataFrame) -> DataFrame:
    """Percent of each band's holders that voted, per proposal."""
    size = bands.groupBy("band").agg(F.count(F.lit(1)).alias("members"))
    per = votes.select("proposal", "address").distinct().join(bands.select("address", "band"), "address").groupBy("proposal", "band").agg(F.count(F.lit(1)).alias("voted"))
    grid = votes.select("proposal").distinct().crossJoin(F.broadcast(size))  # at most four bands
    j = grid.join(per, ["proposal", "band"], "left").withColumn("voted", F.coalesce("voted", F.lit(0)))
    return j.withColumn("percent", F.col("voted") / F.col("members") * 100)


def votes_per_holder(votes: DataFrame, holders: DataFrame) -> DataFrame:
    """How many holders took part in how many proposals, zero included."""
    n = votes.select("proposal", "address").distinct().groupBy("address").agg(F.count(F.lit(1)).alias("num_votes"))
    j = holders.select("address").join(n, "address", "left").withColumn("num_votes", F.coalesce("num_votes", F.lit(0)))
    return j.groupBy("num_votes").agg(F.count(F.lit(1)).alias("holders"))


def clean_proposals(proposals: DataFrame, rules: Sequence[tuple[str, str]], other: str, pass_share: Mapping[str, float], quorum: float) -> DataFrame:
    """Two-choice proposals with scores: category, quorum flag, share for, result (1 for, 2 against).

    ``pass_share`` states the share a category needs; others need half.
    """
    rows = proposals.where((F.size("choices") == 2) & (F.col("scores_total") != 0))
    share = dbl(F.element_at("scores", 1)) / dbl("scores_total")
    rows = rows.withColumns({"category": category_of("title", rules, other), "reached_quorum": F.col("scores_total") > quorum, "percentage_for": share})
    return rows.withColumn("result", F.when(F.col("percentage_for") > _needed(pass_share), 1).otherwise(2))


def _needed(pass_share: Mapping[str, float]) -> Column:
    out = F.lit(0.5)
    for category, share in pass_share.items():
        out = F.when(F.col("category") == category, F.lit(share)).otherwise(out)
    return out


def drop_zero_power(votes: DataFrame) -> DataFrame:
    """Votes of proposals whose voting power does not add up to zero."""
    zero = votes.groupBy("proposal").agg(F.sum("vp").alias("_s")).where(F.col("_s") == 0).select("proposal")
    return votes.join(zero, "proposal", "left_anti")


def closed(proposals: DataFrame) -> DataFrame:
    """Proposals whose vote is over."""
    return proposals.where(F.col("state") == "closed")


def deciding_votes(votes: DataFrame, proposals: DataFrame, pass_share: Mapping[str, float]) -> DataFrame:
    """Winning votes of closed proposals with their part of the coalition, and whether the switch of this voter flips the result."""
    p = closed(proposals).select(F.col("proposal_id").alias("proposal"), "category", "scores", "scores_total", "votes", "reached_quorum", "result")
    j = votes.join(p, "proposal").where(F.col("choice") == F.col("result"))
    coalition = dbl(F.element_at("scores", F.col("choice").cast("int")))
    j = j.withColumns({"coalition_vp": coalition, "coalition_contribution": safe_div("vp", coalition)})
    other_side = (dbl("scores_total") - (F.col("coalition_vp") - dbl("vp"))) / dbl("scores_total")
    # the other side needs the pass share when it is "for", and its complement when it is "against"
    needs = F.when(F.col("choice") == 2, _needed(pass_share)).otherwise(F.lit(1.0) - _needed(pass_share))
    label = F.when(~F.col("reached_quorum"), F.lit("no quorum")).when(other_side > needs, F.lit("Was Deciding Voter")).otherwise(F.lit("Not Deciding Voter"))
    return j.withColumn("is_deciding_vote", label).drop("scores")


# fixed values: the kinds of winning votes
DECIDING = ["Was Deciding Voter", "Not Deciding Voter", "no quorum"]


def deciding_by_voter(winning: DataFrame) -> DataFrame:
    """Counts of each kind of vote per voter with their voting power range; one aggregation."""
    counts = [count_if(F.col("is_deciding_vote") == k).alias(k.lower().replace(" ", "_")) for k in DECIDING]
    mean = (F.sum("vp").cast("double") / F.count("vp")).alias("mean_vp")
    return winning.groupBy("voter").agg(*counts, mean, F.min(dbl("vp")).alias("min_vp"), F.max(dbl("vp")).alias("max_vp"))


def deciding_by_proposal(winning: DataFrame) -> DataFrame:
    per = winning.groupBy("proposal", "category", "votes", "reached_quorum").agg(count_if(F.col("is_deciding_vote") == DECIDING[0]).alias("num_deciding_votes"))
    label = F.when(~F.col("reached_quorum"), F.lit("no quorum")).when(F.col("num_deciding_votes") > 0, F.lit("Has Deciding Voter")).otherwise(F.lit("No Deciding Voter"))
    return per.withColumn("has_deciding_vote", label)


def deciding_by_category(per_proposal: DataFrame) -> DataFrame:
    """Proposals per category and kind, as columns filled with zero."""
    kinds = ["Has Deciding Voter", "No Deciding Voter", "no quorum"]
    return per_proposal.groupBy("category").agg(*[count_if(F.col("has_deciding_vote") == k).alias(k.lower().replace(" ", "_")) for k in kinds])
