"""Queries over the given tables by name, and their SQL."""

from __future__ import annotations

from palimpsest.plans import files, graphs, history, merges

QUERIES = graphs.QUERIES | files.QUERIES | history.QUERIES | merges.QUERIES
ORACLES = graphs.ORACLES | files.ORACLES | history.ORACLES | merges.ORACLES
