"""Every registered query with its SQL, collected from the operator modules."""

from __future__ import annotations

from quillon.functions import html, scalars, user_defined
from quillon.operators import aggregates, containment, joins, quantiles, ranking, reshaping, sketches, vectors, windows
from quillon.plans.registry import Registry
from quillon.sources import buckets, sqlite
from quillon.streaming import timers

MODULES = (joins, aggregates, windows, reshaping, scalars, user_defined, containment, quantiles, ranking, vectors, sketches, html, sqlite, buckets, timers)


def _all() -> Registry:
    out = Registry()
    for module in MODULES:
        out.add_all(module.registry)
    return out


def queries() -> dict:
    return _all().queries


def oracle_sql() -> dict[str, str]:
    return _all().sql
