"""The registered queries and their DuckDB equivalents."""

from quern.plans import event_queries, python_queries, rule_queries, run_queries, source_queries, stream_queries, text_queries  # noqa: F401
from quern.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
