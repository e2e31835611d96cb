"""Token analytics on PySpark: ledgers, balances, issuance, prices, revenue,
cohorts, liquidity, treasury and governance as lazy DataFrame operators."""
