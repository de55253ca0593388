"""The flagship plan: project position and cost-performance status, one row per project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import portfolio, rules
from ledgerloom.plans import bindings as b

C = F.col


def project_status(spark: SparkSession, sf: str) -> DataFrame:
    model = b.project_model(spark, sf)
    rows = portfolio.scoped(portfolio.base_rows(b.with_methods(model)))
    status = rules.cost_performance(C("ev"), C("ac"), C("cpi"), C("cv"))
    return rows.select("id", "name", "period", "budget", "ev", "ac", "cv", "cpi", status.alias("status"))
