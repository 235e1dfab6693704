from basketry.plans.registry import REGISTRY, register, queries, oracle_sql

__all__ = ["REGISTRY", "register", "queries", "oracle_sql"]
