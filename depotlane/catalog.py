"""The queries over the stock tables, with their SQL for comparison."""

from __future__ import annotations

from depotlane.plans import abc, basket, forecast, service

MODULES = (abc, basket, service, forecast)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
FLAGSHIP = "abc_article"
