"""Queries that apply the engine's operators to the standard tables, each with the SQL it is checked against."""

from keelstone.catalog import language, scans, search, store  # noqa: F401
from keelstone.catalog._registry import QUERIES, SQL  # noqa: F401
