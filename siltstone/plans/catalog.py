"""Every registered query and its SQL twin, by name."""

from __future__ import annotations

from siltstone.plans import code_queries, enrich_queries, graph_queries, search_ranked, search_text, set_queries, stream_queries, telemetry

MODULES = (search_ranked, enrich_queries, graph_queries, telemetry, search_text, set_queries, stream_queries, code_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
