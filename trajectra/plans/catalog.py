"""The registered queries and their SQL."""

from __future__ import annotations

from . import q_distances, q_domains, q_events, q_gaps, q_groups, q_models, q_paths, q_sequences, q_statistics, q_validation

MODULES = (q_sequences, q_distances, q_paths, q_groups, q_events, q_gaps, q_domains, q_statistics, q_models, q_validation)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
