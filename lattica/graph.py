"""The graph handle that operators take: two DataFrames and what is derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

TABLES = ("nodes", "edges", "communities", "flows", "memberships")
Table = DataFrame | Callable[[], DataFrame] | None


class Graph:
    """Nodes and edges, with optional derived tables; every operator reads only the columns it names.

    ``communities`` is (qualified_name, community_id); ``flows`` is (flow_id,
    entry, depth, criticality); ``memberships`` is (flow_id, qualified_name, position).
    A table may be given as a function that makes it; it is called when the
    table is first asked for, so what a query does not read is not made.
    """

    def __init__(self, nodes: Table, edges: Table, communities: Table = None, flows: Table = None, memberships: Table = None):
        self._tables = dict(zip(TABLES, (nodes, edges, communities, flows, memberships), strict=True))

    def _table(self, name: str) -> DataFrame | None:
        given = self._tables[name]
        if callable(given):
            given = self._tables[name] = given()
        return given

    nodes = property(lambda self: self._table("nodes"))
    edges = property(lambda self: self._table("edges"))
    communities = property(lambda self: self._table("communities"))
    flows = property(lambda self: self._table("flows"))
    memberships = property(lambda self: self._table("memberships"))

    def with_(self, **tables: Table) -> Graph:
        return Graph(**(self._tables | tables))
