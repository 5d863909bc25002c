"""Registered queries of the engine's operators and the SQL they are held against."""

from __future__ import annotations

from . import alignments, audit, catalogs, comparison, ensembles, evaluation, formats, logs, records, stores, streams, structures, trajectories

MODULES = (catalogs, trajectories, ensembles, alignments, logs, records, comparison, evaluation, audit, structures, stores, formats, streams)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
