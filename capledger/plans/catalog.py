"""Queries over the driver's tables, one or more for each operator, and the same in SQL."""

from __future__ import annotations

from capledger.plans import detection, judged, native, upkeep

QUERIES: dict = {**native.QUERIES, **detection.QUERIES, **upkeep.QUERIES, **judged.QUERIES}
SQL: dict = {**native.SQL, **detection.SQL, **upkeep.SQL, **judged.SQL}
