"""All registered queries but those of the optional subpackage."""

from __future__ import annotations

from emberlog.plans import checks_correlation, checks_detection, checks_ingest, checks_response, checks_streaming

MODULES = (checks_detection, checks_correlation, checks_response, checks_ingest, checks_streaming)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
