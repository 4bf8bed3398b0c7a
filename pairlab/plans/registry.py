"""All registered queries and their SQL."""

from __future__ import annotations

from pairlab.plans import cards, daily, extra, intraday, stores  # noqa: F401  register their queries with daily


def queries() -> dict:
    return dict(daily.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(daily.ORACLES)
