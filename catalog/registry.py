"""All registered queries and their SQL."""

from importlib import import_module

_SECTIONS = ("scalar", "windowing", "joining", "aggregating", "evaluating", "ordering", "taxa", "lca", "pairs",
             "trees", "graphs", "models", "files", "streams", "pipelines")

QUERIES = {}
ORACLES = {}
for _section in _SECTIONS:
    _catalog = import_module(f"catalog.{_section}").catalog
    QUERIES.update(_catalog.queries)
    ORACLES.update(_catalog.oracles)
