"""Named queries, grouped by subject."""

import importlib

MODULES = ["metric_views", "sql_layer", "customer", "inventory", "cross_domain", "jobs", "contracts", "text", "streams"]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"shelfstar.plans.{m}")
