"""All registered queries of the fidelity engine, with their DuckDB counterparts."""

from slotmeter.plans import aligned, building, core, datasets, files, notation, paired, protocols, routing, scoring, tables

_MODULES = (core, routing, datasets, notation, building, tables, aligned, files, scoring, paired, protocols)

QUERIES: dict = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
