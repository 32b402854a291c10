"""All registered queries."""

from barloom.plans import backtest, fundamentals, holdings, intake, learning, live, monitoring, portfolio, replay, risk, screen, technical, thresholds  # noqa: F401
from barloom.plans.registry import QUERIES, SQL

FLAGSHIP = "risk_snapshot"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
