"""All registered queries and their oracles."""

from docgraph.plans import queries_core, queries_names, queries_pages, queries_registry, queries_requests, queries_routes, queries_sources, queries_vertices  # noqa: F401
from docgraph.plans.registering import ORACLES, QUERIES  # noqa: F401
