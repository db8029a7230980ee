"""All registered queries outside the corpus operators."""

from . import documents, events, models, projects, retrieve, rules, search, tables, texts  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
