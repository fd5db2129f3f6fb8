"""All registered queries outside the training-data operators, and their SQL."""

from siftwell.plans import queries, stores

QUERIES = queries.QUERIES | stores.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | stores.ORACLE_SQL
