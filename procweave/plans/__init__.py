"""The registered queries, one module for each family; importing this package registers them all."""

from procweave.plans import catalog, edge_cases, extraction, files, graph, relational, reports, scalar, scripting, whole  # noqa: F401
