"""All registered queries (importing a module registers its queries)."""

from __future__ import annotations

from touchline.plans import registry
from touchline.plans import queries_io  # noqa: F401
from touchline.plans import queries_model  # noqa: F401
from touchline.plans import queries_more  # noqa: F401
from touchline.plans import queries_training  # noqa: F401

REGISTRY = registry.REGISTRY
queries = registry.queries
oracle_sql = registry.oracle_sql
