"""All queries of the core, and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vocandra.plans import core_queries, requirement_queries, units_queries  # noqa: F401 - registers its queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**core_queries.QUERIES, **units_queries.QUERIES}
ORACLES: dict[str, str] = dict(core_queries.ORACLES)
flagship = core_queries.flagship
