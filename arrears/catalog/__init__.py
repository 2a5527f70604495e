"""Registered queries: each runs operators on the given tables and has an equivalent in plain SQL."""

from arrears.catalog.base import ENTRIES
from arrears.catalog import (  # noqa: F401  (importing registers the queries)
    composites, histories, python_code, rating, scalars, stored, texts,
)

__all__ = ["ENTRIES"]
