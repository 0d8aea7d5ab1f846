"""SQL that gives the same results as the queries of `plumbline.plans.registry`, for DuckDB."""

from __future__ import annotations

from oracles.generated import GENERATED
from oracles.reports import REPORTS
from oracles.tables import TABLES

ORACLES = {**TABLES, **GENERATED, **REPORTS}
