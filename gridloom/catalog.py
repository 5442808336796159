"""The registry of named queries and their DuckDB oracles."""

from __future__ import annotations

from gridloom.plans import analysis_queries, panel_queries, reports, resampling_queries, source_queries, survey_queries
from gridloom.sources.scratch import scratch

MODULES = (panel_queries, analysis_queries, resampling_queries, survey_queries, source_queries)


def flagship(spark, sf_dir):
    """Per-entity errors and skill of the forecasts of user days."""
    return panel_queries.household_metrics(spark, sf_dir)


def report_contents(spark, sf_dir):
    """All report tables, each written once after those that it needs, and the rows of each."""
    return reports.written(spark, reports.report_views(spark, sf_dir, _registered("QUERIES")), ["contents"], scratch(spark, "reports"))["contents"]


def _registered(kind: str) -> dict:
    return {name: f for m in MODULES for name, f in getattr(m, kind).items()}


def queries():
    return _registered("QUERIES") | {"report_contents": report_contents}


def oracle_sql():
    found = _registered("SQL")
    count = lambda table, sql: f"SELECT '{table}' AS report, count(*) AS rows FROM ({sql})"
    parts = [count(t, found[q]) for t, q in reports.COPIES.items()] + [count("Table_F_2", found[reports.COPIES["Table_F_1"]]), f"SELECT 'Table_3_3', {len(reports.STRATEGY_ROWS)}"]
    return found | {"report_contents": " UNION ALL ".join(parts)}
