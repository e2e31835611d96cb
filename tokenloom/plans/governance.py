"""Voting power, concentration, proposal and vote reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance as G
from ..operators import ledger as L
from ..operators import staking as S
from ..sources.canonical import Tables
from .registry import define_view, report, rnd, sql
from .treasury import POOLS

QUORUM, THRESHOLD = 14000.0, 0.6
RULES = [("Gate 1", "G1"), ("Gate 2", "G2"), ("Plan", "PLAN")]
PASS = {"G2": 0.6}
OPEN_WEEK = "2024-01-29"  # votes of the last week are still open

define_view("nonvoting", "tags", "select distinct address from tags where type = 'contract'")
define_view("ranked", "holders nonvoting", """
    with h as (select * from holders where address not in (select address from nonvoting))
    select address, cast(balance as double) as balance, row_number() over w as wallet_rank, cast(sum(balance) over () as double) as total,
           cast(balance as double) / cast(sum(balance) over () as double) as share, cast(sum(balance) over w as double) / cast(sum(balance) over () as double) as cum_share
    from h window w as (order by balance desc, address rows unbounded preceding)""")
define_view("bands4", "holders", """
    with r as (select address, balance, row_number() over w as i, sum(balance) over w as c, count(*) over () as n, sum(balance) over () as s
               from holders window w as (order by balance desc, address rows unbounded preceding))
    select address, cast(balance as double) as balance, (i - 1) / n * 100 as percentile, cast(c as double) / cast(s as double) * 100 as percent_of_supply,
           case when (i - 1) / n * 100 < 0.1 then '0.0-0.1%' when (i - 1) / n * 100 < 1.0 then '0.1-1.0%' when (i - 1) / n * 100 < 10.0 then '1.0-10.0%'
                when (i - 1) / n * 100 < 100.0 then '10.0-100.0%' end as band from r""")
define_view("votes", "ev", """
    select event_type || '/' || cast(cast(date_trunc('week', ts) as date) as varchar) as proposal, address as voter, case when k < 52 then 1 else 2 end as choice, value as vp, event_id
    from ev""")
define_view("ballots", "votes", """
    select proposal, voter as address, sum(vp) as balance, arg_max(choice, event_id) as choice from votes group by all""")
define_view("props", "votes", """
    select *, case when title like '%Gate 1%' then 'G1' when title like '%Gate 2%' then 'G2' when title like '%Plan%' then 'PLAN' else 'Other' end as category,
           scores_total > 19000 as reached_quorum, f / scores_total as percentage_for,
           case when f / scores_total > (case when title like '%Gate 2%' then 0.6::double else 0.5::double end) then 1 else 2 end as result
    from (select proposal as proposal_id,
                 case split_part(proposal, '/', 1) when 'view' then 'Gate 1 ' when 'click' then 'Gate 2 ' when 'signup' then 'Plan ' else 'Other ' end || proposal as title,
                 cast(coalesce(sum(vp) filter (where choice = 1), 0) as double) as f, cast(coalesce(sum(vp) filter (where choice = 2), 0) as double) as a,
                 cast(sum(vp) as double) as scores_total, count(*) as votes
          from votes group by proposal) where title not like 'Other error%'""")
define_view("winning", "votes props", """
    select v.proposal, v.voter, v.choice, v.event_id, cast(v.vp as double) as vp, category, votes, reached_quorum, result, scores_total,
           case when choice = 1 then f else a end as coalition_vp,
           case when not reached_quorum then 'no quorum'
                when (scores_total - ((case when choice = 1 then f else a end) - cast(v.vp as double))) / scores_total
                     > case when category = 'G2' then (case when choice = 2 then 0.6::double else 1 - 0.6::double end) else 0.5::double end then 'Was Deciding Voter'
                else 'Not Deciding Voter' end as is_deciding_vote
    from votes v join props p on p.proposal_id = v.proposal where choice = result and split_part(v.proposal, '/', 2) < '2024-01-29'""")


def nonvoting(t: Tables):
    return t.labels.where("type = 'contract'").select("address")


def ranked(t: Tables):
    return G.rank_wallets(t.holders, nonvoting(t))


def votes(t: Tables):
    week = F.to_date(F.date_trunc("week", "ts")).cast("string")
    return t.ev.select(
        F.concat_ws("/", "event_type", week).alias("proposal"), F.col("address").alias("voter"), F.when(F.col("k") < 52, 1).otherwise(2).alias("choice"),
        F.col("value").alias("vp"), "event_id",
    )


def ballots(t: Tables):
    return votes(t).groupBy("proposal", F.col("voter").alias("address")).agg(F.sum("vp").alias("balance"), F.max_by("choice", "event_id").alias("choice"))


def proposals(t: Tables):
    v = votes(t).groupBy("proposal").agg(
        F.coalesce(F.sum(F.when(F.col("choice") == 1, F.col("vp"))), F.lit(0)).cast("double").alias("f"),
        F.coalesce(F.sum(F.when(F.col("choice") == 2, F.col("vp"))), F.lit(0)).cast("double").alias("a"),
        F.sum("vp").cast("double").alias("scores_total"), F.count(F.lit(1)).alias("votes"),
    )
    kind = F.split("proposal", "/")[0]
    word = F.when(kind == "view", "Gate 1 ").when(kind == "click", "Gate 2 ").when(kind == "signup", "Plan ").otherwise("Other ")
    two = F.array(F.lit("for"), F.lit("against"))
    return v.select(
        F.col("proposal").alias("proposal_id"), F.concat(word, F.col("proposal")).alias("title"),
        F.when(kind == "error", F.array(F.lit("for"), F.lit("against"), F.lit("abstain"))).otherwise(two).alias("choices"),
        F.array("f", "a").alias("scores"), "scores_total", "votes", F.when(F.split("proposal", "/")[1] == OPEN_WEEK, F.lit("active")).otherwise(F.lit("closed")).alias("state"),
    )


def cleaned(t: Tables):
    return G.clean_proposals(proposals(t), RULES, "Other", PASS, 19000)


def winning(t: Tables):
    return G.deciding_votes(G.drop_zero_power(votes(t)), cleaned(t), PASS)


@report("o01_rank_wallets", sql("ranked", "select * from ranked"))
def _(t):
    return ranked(t)


@report("o02_nakamoto", sql("ranked", "select min(wallet_rank) as nakamoto from ranked where cum_share > 0.6"))
def _(t):
    return G.nakamoto(ranked(t))


VEST = [("0x00000003", "0x00000020"), ("0x00000008", "0x00000021"), ("0x00000009", "0x00000021")]


@report("o03_voting_power", sql("latest_bal smoves ev signed nonvoting", """,
    w as (select holder as address, cast(balance as double) as own from latest_bal where token = 'P0'),
    v(vesting_address, voting_address) as (values ('0x00000003', '0x00000020'), ('0x00000008', '0x00000021'), ('0x00000009', '0x00000021')),
    held as (select holder as address, balance as a from latest_bal where token = 'P2' union all select address, amount from smoves),
    rate as (select arg_max(cast(k as double), event_id) / cast((select -sum(amount) from signed where token = 'P2' and holder = '0x00000000') as double) as r
             from ev where event_type = 'click' and pool = 'P2'),
    parts as (select address, own, 0.0::double as vesting, 0.0::double as pooled from w
              union all select address, 0, 0, cast(sum(a) as double) * (select r from rate) from held group by address
              union all select voting_address, 0, cast(sum(balance) as double), 0 from v join (select holder, balance from latest_bal where token = 'P0') b on b.holder = vesting_address group by 1),
    s as (select address, sum(own) as own, sum(vesting) as vesting, sum(pooled) as pooled from parts group by address)
    select address, own, vesting, pooled, own + vesting + pooled as total_votes,
           case when address in (select address from nonvoting) then 'Nonvoting' else 'Voting' end as wallet_type
    from s where address <> '0x00000000' and address not in (select vesting_address from v)"""))
def _(t):
    bal = L.balance_latest(L.daily_change(L.signed_ledger(t.transfers)))
    own = bal.where("token = 'P0'").select(F.col("holder").alias("address"), "balance")
    held = bal.where("token = 'P2'").select(F.col("holder").alias("address"), F.col("balance").alias("amount"))
    held = held.unionByName(S.stake_moves(t.transfers, POOLS, "P2").select("address", "amount"))
    lp = L.signed_ledger(t.transfers).where(f"token = 'P2' and holder = '{L.ZERO}'").agg((-F.sum("amount")).alias("total"))
    clicks = t.of_type("click").where("pool = 'P2'").select("block", "idx", F.col("k").alias("reserve"))
    vest = t.spark.createDataFrame(VEST, "vesting_address string, voting_address string")
    return G.voting_power(own, [("pooled", held, G.units_per_lp(clicks, lp))], F.broadcast(vest), nonvoting(t))


@report("o04_gini", sql("holders", """,
    r as (select balance, row_number() over (order by balance, address) as i from holders)
    select count(*) as n, round(2.0::double * sum(i * cast(balance as double)) / (count(*) * cast(sum(balance) as double)) - (count(*) + 1) / count(*), 9) as gini from r"""))
def _(t):
    return rnd(G.gini(t.holders, "balance", "address"), 9, "gini")


@report("o04_lorenz", sql("holders", """
    select address, row_number() over w / cast(count(*) over () as double) as population_share,
           cast(sum(balance) over w as double) / cast(sum(balance) over () as double) as value_share
    from holders window w as (order by balance, address rows unbounded preceding)"""))
def _(t):
    return G.lorenz(t.holders, "balance", "address")


@report("o05_min_voters", sql("holders", """,
    r as (select row_number() over w as i, sum(balance) over w as c, sum(balance) over () as s, count(*) over () as n from holders window w as (order by balance desc, address rows unbounded preceding))
    select min(i) filter (where c > 500000) as min_voters, max(n) - max(i - 1) filter (where s - c > 500000) as min_small_voters from r"""))
def _(t):
    return G.min_voters(t.holders, 500000)


@report("o06_percentile_bands", sql("bands4", "select * from bands4"))
def _(t):
    return G.percentile_bands(t.holders)


@report("o07_vote_outcome", sql("ballots holders", """,
    p as (select proposal, cast(coalesce(sum(balance) filter (where choice = 1), 0) as double) as votes_for, count(*) filter (where choice = 1) as voters_for,
                 cast(coalesce(sum(balance) filter (where choice = 2), 0) as double) as votes_against, count(*) filter (where choice = 2) as voters_against from ballots group by proposal),
    q as (select *, votes_for / nullif(votes_for + votes_against, 0) as in_favor, votes_for > 14000 as quorum_reached,
                 case when votes_for > 14000 and votes_for / (votes_for + votes_against) > 0.6 then 1 else 0 end as succeeded from p),
    s as (select *, case when succeeded = 1 then 0.0::double else round(14000.0::double - votes_for, 2) end as short_by from q),
    r as (select proposal, min(i) as m from (select proposal, row_number() over w as i, sum(balance) over w as c from ballots
          window w as (partition by proposal order by balance desc, address rows unbounded preceding)) where c > 14000 group by proposal),
    h as (select s.proposal, count(*) as k from s join holders on cast(balance as double) > short_by where succeeded = 0 group by 1)
    select s.proposal, votes_for, voters_for, votes_against, voters_against, in_favor, quorum_reached, cast(succeeded as bigint) as succeeded, short_by,
           case when succeeded = 1 then m end as min_voters, k as rescue_rank
    from s left join r on r.proposal = s.proposal left join h on h.proposal = s.proposal"""))
def _(t):
    return G.vote_outcome(ballots(t), t.holders, QUORUM, THRESHOLD)


@report("o08_turnout", sql("ballots bands4", """,
    m as (select band, count(*) as members from bands4 group by band),
    v as (select proposal, band, count(*) as voted from ballots b join bands4 h on h.address = b.address group by all)
    select p.proposal, m.band, members, coalesce(voted, 0) as voted, cast(coalesce(voted, 0) as double) / members * 100 as percent
    from (select distinct proposal from ballots) p cross join m left join v on v.proposal = p.proposal and v.band = m.band"""))
def _(t):
    return G.turnout(ballots(t), G.percentile_bands(t.holders))


@report("o08_votes_per_holder", sql("ballots holders", """
    select num_votes, count(*) as holders from (select h.address, count(b.proposal) as num_votes from holders h left join ballots b on b.address = h.address group by 1) group by 1"""))
def _(t):
    return G.votes_per_holder(ballots(t), t.holders)


@report("o09_clean_proposals", sql("props", "select proposal_id, title, scores_total, votes, category, reached_quorum, percentage_for, cast(result as bigint) as result from props"))
def _(t):
    return cleaned(t).drop("choices", "scores", "state")


@report("o10_drop_zero_power", sql("ev", """,
    v as (select event_type || '/' || cast(day as varchar) as proposal, address as voter, case when k < 90 then 0 else value end as vp from ev where value < 2)
    select proposal, voter, cast(vp as double) as vp from v where proposal in (select proposal from v group by 1 having sum(vp) <> 0)"""))
def _(t):
    power = F.when(F.col("k") < 90, F.lit(0)).otherwise(F.col("value"))
    v = t.ev.where("value < 2").select(F.concat_ws("/", "event_type", F.col("day").cast("string")).alias("proposal"), F.col("address").alias("voter"), power.alias("vp"))
    return G.drop_zero_power(v)


@report("o11_deciding_votes", sql("winning", """
    select proposal, voter, cast(choice as bigint) as choice, event_id, vp, category, votes, reached_quorum, cast(result as bigint) as result, scores_total, coalition_vp,
           vp / coalition_vp as coalition_contribution, is_deciding_vote from winning"""))
def _(t):
    return winning(t)


@report("o12_deciding_by_voter", sql("winning", """
    select voter, count(*) filter (where is_deciding_vote = 'Was Deciding Voter') as was_deciding_voter, count(*) filter (where is_deciding_vote = 'Not Deciding Voter') as not_deciding_voter,
           count(*) filter (where is_deciding_vote = 'no quorum') as no_quorum, cast(sum(cast(vp as decimal(18,2))) as double) / count(vp) as mean_vp, min(vp) as min_vp, max(vp) as max_vp
    from winning group by voter"""))
def _(t):
    return G.deciding_by_voter(winning(t))


BY_PROPOSAL = """
    , d as (select proposal, category, votes, reached_quorum, count(*) filter (where is_deciding_vote = 'Was Deciding Voter') as num_deciding_votes from winning group by all),
    x as (select *, case when not reached_quorum then 'no quorum' when num_deciding_votes > 0 then 'Has Deciding Voter' else 'No Deciding Voter' end as has_deciding_vote from d)"""


@report("o12_deciding_by_proposal", sql("winning", BY_PROPOSAL + "select * from x"))
def _(t):
    return G.deciding_by_proposal(winning(t))


@report("o12_deciding_by_category", sql("winning", BY_PROPOSAL + """
    select category, count(*) filter (where has_deciding_vote = 'Has Deciding Voter') as has_deciding_voter, count(*) filter (where has_deciding_vote = 'No Deciding Voter') as no_deciding_voter,
           count(*) filter (where has_deciding_vote = 'no quorum') as no_quorum from x group by category"""))
def _(t):
    return G.deciding_by_category(G.deciding_by_proposal(winning(t)))
