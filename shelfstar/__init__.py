"""Retail star schema, stock ledger, metrics and text preparation as Spark jobs."""
