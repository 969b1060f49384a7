"""Every query of the clinical operators over the test tables, with its DuckDB equivalent where SQL can express it."""

from __future__ import annotations

from wardline.catalog import checks, clinical, coding, cohorts, desk, records, scoring, shifting, survival, temporal, trees

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in (clinical, temporal, coding, scoring, checks, records, cohorts, desk, survival, shifting, trees):
    QUERIES |= _part.CATALOG.queries
    ORACLES |= _part.CATALOG.oracles
