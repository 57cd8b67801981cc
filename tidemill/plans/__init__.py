"""Star schema, analytic queries, marts and service-level windows."""
