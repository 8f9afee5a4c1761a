"""Named queries over the tables, and the SQL that must give the same rows."""

from __future__ import annotations

from . import queries
from .sql import SQL

QUERIES = {name: getattr(queries, name) for name in SQL}

__all__ = ["QUERIES", "SQL"]
