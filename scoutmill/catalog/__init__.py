"""All queries over the driver tables."""

from scoutmill.catalog import corpus_queries, group_queries, job_queries, source_queries, table_queries, trajectory_queries  # noqa: F401
from scoutmill.catalog.base import QUERIES, SQL  # noqa: F401
