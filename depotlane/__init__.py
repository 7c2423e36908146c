"""Depotlane: Spark jobs for stock movements, picking baskets and workload forecasts."""
