"""Queries bound to the given tables."""

from importlib import import_module

MODULES = ("text_queries", "tag_queries", "score_queries", "graph_queries", "report_queries", "evaluate_queries", "lexicon_queries", "ingest_queries")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
