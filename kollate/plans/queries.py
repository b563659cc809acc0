"""All queries of the core, by name."""

from kollate.plans import linkage, records, relational, reports, scalars, sources  # noqa: F401
from kollate.plans.registry import ORACLES, QUERIES  # noqa: F401
