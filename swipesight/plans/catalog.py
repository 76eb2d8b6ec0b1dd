"""All registered queries."""

from __future__ import annotations

from swipesight.plans import catalog_behaviour, catalog_customers, catalog_models, catalog_profile
from swipesight.plans.query import Query

GROUPS = [catalog_profile, catalog_customers, catalog_behaviour, catalog_models]


def entries() -> dict[str, Query]:
    return {name: query for group in GROUPS for name, query in group.entries().items()}
