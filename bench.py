"""Time the headline reports; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores. Every report is run to the end without moving rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tokenloom.plans.catalog import REPORTS
from tokenloom.session import build_session

HEADLINE = [
    "i04_balance_daily", "i08_holder_count", "i09_multi_product_holders", "i12_holder_stats", "i17_circulating_supply",
    "j02_issuance_daily", "j04_unit_supply", "j09_swap_price_feed", "j11_median_trade_price", "j14_trade_volatility", "j16_revenue_daily",
    "j23_flow_growth_smoothed", "j25_trading_volume", "j26_buys_sells", "j27_trend_unit_supply", "j30_pnl_cumulative",
    "k03_user_base", "k05_retention", "k07_net_unit_retention", "k11_repeat_buyers", "k19_capped_outflow",
    "l02_lp_exposure_v2", "l03_lp_exposure_v3", "l06_exposed_holders", "l11_liquidity_bands", "l13_price_impact_v3",
    "m02_nav_vs_market", "m03_leverage_ratio", "n01_treasury_over_time_week", "n08_staker_rewards",
    "o01_rank_wallets", "o07_vote_outcome", "o11_deciding_votes", "p02_market_share", "p05_spearman_rows",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
        spark__sql__files__maxPartitionBytes="8m", spark__sql__files__openCostInBytes="1m",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{path}/events.parquet").write.format("noop").mode("overwrite").save()  # start the executor threads
    times = {}
    for name in names:
        begin = time.time()
        REPORTS[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
    print(json.dumps({"metric": "headline_reports_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(path.rstrip("/"))}))


if __name__ == "__main__":
    main()
