"""All queries of the library and their SQL."""

from . import context, documents, lookups, queries, ranges, search, upkeep

QUERIES = queries.QUERIES | upkeep.QUERIES | documents.QUERIES | lookups.QUERIES | search.QUERIES | ranges.QUERIES | context.QUERIES
ORACLES = queries.ORACLES | upkeep.ORACLES | documents.ORACLES | lookups.ORACLES | search.ORACLES | ranges.ORACLES | context.ORACLES
