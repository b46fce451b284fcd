"""All queries over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from quarryset.plans import keyed, search

QUERIES = {**keyed.QUERIES, **search.QUERIES}
SQL = {**keyed.SQL, **search.SQL}
