"""All reports, in the order of their areas."""

from . import ledger, issuance, liquidity, cohorts, treasury, governance, market, primitives  # noqa: F401, I001
from .registry import REPORTS

__all__ = ["REPORTS"]
