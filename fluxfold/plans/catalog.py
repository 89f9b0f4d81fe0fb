"""All registered queries."""

from fluxfold.plans import (  # noqa: F401
    catalog_scalars,
    catalog_series,
    catalog_sources,
    catalog_tables,
    catalog_views,
)
from fluxfold.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
