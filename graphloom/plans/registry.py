"""All queries of the core, by name."""

from . import general, reference

QUERIES = {**reference.QUERIES, **general.QUERIES}
ORACLES = {**reference.ORACLES, **general.ORACLES}
