"""All queries of the engine with the SQL that checks them."""

from __future__ import annotations

from factloom.plans import assess, calls, facts, findings, graphs, inout, ipc, problems, tables

FLAGSHIP = "hub_rank"

_MODULES = (problems, facts, calls, ipc, assess, inout, findings, graphs, tables)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
