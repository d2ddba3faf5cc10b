"""DuckDB SQL of the registered queries."""

from trackloom.plans.queries import SQL

__all__ = ["SQL"]
