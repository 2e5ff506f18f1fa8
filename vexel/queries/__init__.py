"""The registered queries over the driver's tables, and the same in DuckDB SQL, by group."""

from __future__ import annotations

from vexel.queries import access, clusters, filtering, recommending, searching, stores, texts, vectors

GROUPS = (vectors, filtering, searching, clusters, access, stores, texts, recommending)

QUERIES = {name: q for g in GROUPS for name, q in g.QUERIES.items()}
ORACLES = {name: q for g in GROUPS for name, q in g.ORACLES.items()}
