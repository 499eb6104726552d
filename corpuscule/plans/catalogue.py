"""All queries over the driver tables, gathered from their families."""

from . import corpus_queries, text_queries

QUERIES = text_queries.Q | corpus_queries.Q
ORACLE_SQL = text_queries.SQL | corpus_queries.SQL
