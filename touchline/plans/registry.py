"""All registered queries of the match-analytics engine, and their SQL."""

from touchline.plans import match_queries, more_queries, report_queries, tracking_queries

FLAGSHIP = "pass_completion_by_player"
_MODULES = [match_queries, tracking_queries, more_queries, report_queries]
QUERIES: dict = {name: function for module in _MODULES for name, function in module.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
