"""Named queries over the test tables, each with an equivalent SQL text."""

from leadmerge.plans.catalog import mapping, merging, reporting, running, scalars, validating
from leadmerge.plans.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "mapping", "merging", "reporting", "running", "scalars", "validating"]
