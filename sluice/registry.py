"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_batch, queries_core, queries_portal, queries_sources
from .operators import dashboard
from .views import AS_OF, opportunities


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboard: what closes within thirty days, best first."""
    return dashboard.dashboard(opportunities(spark, sf_dir), F.lit(AS_OF).cast("date"), deadline="due_30_days")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**queries_core.QUERIES, **queries_batch.QUERIES, **queries_sources.QUERIES, **queries_portal.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**queries_core.SQL, **queries_batch.SQL, **queries_sources.SQL, **queries_portal.SQL}
