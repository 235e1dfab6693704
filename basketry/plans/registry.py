"""Registry of named queries: a Spark builder (spark, sf_dir) -> DataFrame and,
where the result is SQL-expressible, the DuckDB oracle text."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _load():
    # importing the catalogue modules fills REGISTRY
    from basketry.plans import (q_sources, q_features, q_stats, q_encode,  # noqa: F401
                                q_eval, q_segments, q_models)


def queries() -> dict[str, Callable]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
