"""All queries of the core."""

from __future__ import annotations

from lodestrata.queries import derived, entities, kv, problems, records, series, streams
from lodestrata.queries.registry import Registry


def core_registry() -> Registry:
    registry = Registry()
    for module in (problems, kv, series, entities, records, streams, derived):
        registry.include(module.REGISTRY)
    return registry
