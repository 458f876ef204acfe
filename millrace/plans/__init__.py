"""Pipeline specs, SQL and callable transforms, fan-out and the run ledger."""
