"""Queries over the benchmark tables, one per operator, each with its check in SQL."""

from workloads import aggregates, flows, joins, ledger, ordering, rows, scalars, scans, sinks, sqls  # noqa: F401
