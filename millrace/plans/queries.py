"""All registered queries: importing a module of queries registers them."""

from __future__ import annotations

from millrace.plans import audits, calendar, catalog, consensus, facets, forecasts, fuzzy, golden, governance, indexed, matching, network, planstate, publication, schedules, searching, shortlists, snapshots, textual, titles, zones  # noqa: F401
from millrace.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
