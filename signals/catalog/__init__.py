"""All registered queries: import this package and read ``QUERIES`` and ``SQL``."""

from signals.catalog import cleaning, customers, outlook, retention, revenue  # noqa: F401  (they register themselves)
from signals.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
