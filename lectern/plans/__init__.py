"""Registered queries of the core, each with its SQL where SQL can say it."""

from lectern.plans import catalogue, incremental, more, retrieval, sources, streams, texts, upkeep

MODULES = [incremental, retrieval, catalogue, upkeep, texts, sources, more, streams]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
