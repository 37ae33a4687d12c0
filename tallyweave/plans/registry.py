"""All registered queries with their SQL, by name."""

from tallyweave.plans import evaluation_queries, log_queries, rule_queries, sheet_queries

_MODULES = (evaluation_queries, log_queries, rule_queries, sheet_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
