"""The queries of the training-data operators."""

from __future__ import annotations

from depotlane.llm import bpe, centroids, contamination, fingerprints, ledger, lines, neardup, pages, pii, quality, runs, sharding, substrings

MODULES = (quality, substrings, sharding, fingerprints, pages, lines, contamination, neardup, bpe, pii, ledger, runs, centroids)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
