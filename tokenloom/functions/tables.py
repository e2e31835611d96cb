"""Table functions that SQL can call; they expand into the caller's plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .scalar import ZERO


def create_lp_positions(spark: SparkSession, ledger: str, name: str = "lp_positions", mint_from: str = ZERO, dust: float = 0.01) -> None:
    """Register ``name``(lp_token, token, pair) and ``name``_as_of(lp_token, token, pair, before).

    Each gives (holder, position): every holder's share of the pool's balance of
    ``token``, from the view ``ledger`` (token, day, from_addr, to_addr, value).
    ``before`` is the first day that no longer counts. The pool's tokens are
    added up in one aggregation, as in ``operators.liquidity.lp_share``.
    """
    for function, extra, condition in ((name, "", ""), (f"{name}_as_of", ", before DATE", "AND t.day < before")):
        spark.sql(f"""
            CREATE OR REPLACE TEMPORARY FUNCTION {function}(lp_token STRING, of_token STRING, pair STRING{extra})
            RETURNS TABLE (holder STRING, position DOUBLE)
            RETURN
            WITH moves AS (
                SELECT t.token = lp_token AS is_lp, side.holder = pair AS is_pair, side.holder, side.amount
                FROM {ledger} t LATERAL VIEW inline(array(named_struct('holder', t.to_addr, 'amount', t.value), named_struct('holder', t.from_addr, 'amount', -t.value))) side AS holder, amount
                WHERE t.token IN (lp_token, of_token) {condition}
            ), sums AS (
                SELECT is_lp, holder, sum(amount) AS amount FROM moves WHERE is_lp OR is_pair GROUP BY is_lp, holder
            ), totals AS (
                SELECT cast(-sum(CASE WHEN is_lp AND holder = '{mint_from}' THEN amount END) AS DOUBLE) AS minted,
                       cast(sum(CASE WHEN NOT is_lp THEN amount END) AS DOUBLE) AS held
                FROM sums
            )
            SELECT /*+ BROADCAST(totals) */ s.holder, cast(s.amount AS DOUBLE) / totals.minted * totals.held AS position
            FROM sums s CROSS JOIN totals
            WHERE s.is_lp AND s.holder <> '{mint_from}' AND s.amount > {dust}""")
