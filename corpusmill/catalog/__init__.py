"""Every operator as a query over the given tables."""

from corpusmill.catalog import collect, edges, learn, quality  # noqa: F401
from corpusmill.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
