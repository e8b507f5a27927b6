"""Named queries over the test tables, each with the SQL that must give the same rows."""

from workload import answers, corpus, evaluation, logs, parsing, search, streams  # noqa: F401
from workload.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
