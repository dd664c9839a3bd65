"""Registered queries over the given tables and the SQL texts they are compared with."""

from casemill.checks import evaluation, forms, tables, text  # noqa: F401  (registration)
from casemill.checks.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
