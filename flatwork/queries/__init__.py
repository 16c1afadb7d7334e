"""Registered queries with the SQL that states the same result.

Every module adds its entries on import.
"""

from flatwork.queries.registry import ORACLES, QUERIES  # noqa: F401


def load_all() -> None:
    from flatwork.queries import (  # noqa: F401
        aggregates,
        calculated,
        cleaning,
        eda,
        feature_rules,
        filters,
        profiles,
        projections,
        versions,
    )
