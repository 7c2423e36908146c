"""Queries that apply the operators to the test tables, with SQL for comparison."""
