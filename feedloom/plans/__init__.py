"""Registered queries: each operator bound to tables, with its checking SQL."""

from importlib import import_module

GROUPS = ("text_columns", "source_jobs", "relate_jobs", "report_jobs", "entity_jobs", "rule_jobs", "quality_jobs", "state_jobs")


def load():
    for group in GROUPS:
        import_module(f"{__name__}.{group}")
    return import_module(f"{__name__}.registry")
