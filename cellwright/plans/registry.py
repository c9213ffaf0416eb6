"""All registered queries of the core library and their SQL twins."""

from __future__ import annotations

from . import anomalies, layouts, links, scans, sources_compared

GROUPS = (scans, anomalies, links, sources_compared, layouts)

QUERIES: dict = {k: q for g in GROUPS for k, q in g.R.queries.items()}
ORACLES: dict[str, str] = {k: q for g in GROUPS for k, q in g.R.oracles.items()}
