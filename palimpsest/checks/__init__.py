"""Inputs derived from the test tables, the queries over them, and their SQL counterparts."""

from palimpsest.checks import of_functions, of_links, of_streams, of_tables  # noqa: F401
from palimpsest.checks.registry import ORACLE, QUERIES  # noqa: F401
