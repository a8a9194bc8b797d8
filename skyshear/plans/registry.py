"""All radar queries and their SQL, by name."""

from __future__ import annotations

from skyshear.plans import case_queries, detect_queries, field_queries, grid_queries, misc_queries, scan_queries, summary_queries, wind_queries

FLAGSHIP = "dual_doppler_cells"
_MODULES = (scan_queries, wind_queries, summary_queries, grid_queries, detect_queries, misc_queries, case_queries, field_queries)
QUERIES: dict = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
