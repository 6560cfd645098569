"""All queries of the measurement engine by name, and the SQL that gives the same."""

from __future__ import annotations

from mensura.plans import context, more, shapes, summaries, tables, tests

QUERIES = tables.QUERIES | summaries.QUERIES | tests.QUERIES | more.QUERIES | context.QUERIES | shapes.QUERIES
SQL = tables.SQL | summaries.SQL | tests.SQL | more.SQL | context.SQL | shapes.SQL
