"""Registered queries of the library's core, and their SQL twins."""

from lexigrove.queries import heavy, search

CORE_QUERIES = {**search.QUERIES, **heavy.QUERIES}
CORE_SQL = {**search.SQL, **heavy.SQL}
