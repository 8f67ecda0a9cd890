"""All registered queries; importing the modules fills the registry."""

from hindcast.plans.catalog import backtest, clean, explore, history, learn, pages  # noqa: F401
from hindcast.plans.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
