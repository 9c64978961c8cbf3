"""Registered queries: every operator over the test tables, with the SQL that checks it."""

from sluicegate.queries import casting, changing, checking, intake, loading, reporting, uniqueness  # noqa: F401
from sluicegate.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
