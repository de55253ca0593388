"""Project analytics: roll-ups, rankings, ledger views and report datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import line_sum, ratio, running_total, total_sum


def division_rollup(items: DataFrame) -> DataFrame:
    label = F.coalesce(F.when(F.trim("division") != "", F.col("division")), F.lit("Unclassified"))
    return items.groupBy("project", label.alias("division")).agg(
        *[total_sum(c).alias(n) for n, c in (("budget", "original_budget"), ("ev", "ev"), ("ac", "ac"))]
    )


def performance_points(items: DataFrame) -> DataFrame:
    return items.filter(F.col("cpi_to_date").isNotNull()).select(
        "project", "main_code", "division", (F.col("completion") * 100).alias("x"),
        F.col("cpi_to_date").alias("y"), F.col("original_budget").alias("size"),
    )


def grouped_total(rows: DataFrame, keys: list[str], label: Column, value: Column, fallback: str = "Other") -> DataFrame:
    """(keys, name, value) with a fallback label for blanks."""
    name = F.when(F.coalesce(F.trim(label), F.lit("")) == "", fallback).otherwise(label)
    return rows.groupBy(*keys, name.alias("name")).agg(total_sum(value).alias("value"))


def top_n(grouped: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    """First n rows per key. The rank filter is pushed below the shuffle, so a hot
    key sends at most n rows per task to its window."""
    w = W.partitionBy(*keys).orderBy(order.desc(), F.col("name"))
    return grouped.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def pareto(rows: DataFrame, label: Column, value: Column, n: int) -> DataFrame:
    """Top-n names per project with the cumulative share of the project total."""
    grouped = grouped_total(rows, ["project"], label, value)
    totals = grouped.groupBy("project").agg(total_sum("value").alias("total"))
    w = W.partitionBy("project").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    top = top_n(grouped, ["project"], F.col("value"), n).join(totals, "project")
    return top.select("project", "rank", "name", "value", ratio(running_total("value", w), F.col("total")).alias("cumulative_share"))


def concentration(rows: DataFrame, keys: list[str], label: Column, value: Column) -> DataFrame:
    """Positive amounts by trimmed lower-case label: label count, total and top."""
    name = F.lower(F.trim(label))
    name = F.when(F.coalesce(name, F.lit("")) == "", "other").otherwise(name)
    grouped = rows.filter(value > 0).groupBy(*keys, name.alias("name")).agg(total_sum(value).alias("v"))
    return grouped.groupBy(*keys).agg(
        F.count("*").alias("row_count"), total_sum("v").alias("total"), F.max("v").alias("top")
    )


def source_mix(ledger: DataFrame) -> DataFrame:
    """Amount per source and the share of the positive parts."""
    g = grouped_total(ledger, ["project"], F.col("source"), F.col("total_cost"), "Unknown")
    positive = F.greatest(F.col("value"), F.lit(0.0))
    total = g.groupBy("project").agg(total_sum(positive).alias("total"))
    return g.join(total, "project").select("project", "name", "value", ratio(positive, F.col("total")).alias("share"))


def ledger_trend(ledger: DataFrame) -> DataFrame:
    return ledger.select("project", F.inline("months")).groupBy("project", "month").agg(total_sum("total").alias("total"))


def ledger_page(ledger: DataFrame, search: str, di: str | None, source: str | None, page: int, size: int = 50) -> DataFrame:
    """Search over the text fields plus class and source filters, one ordered page.

    The page is a top-k (offset + limit): no task sorts the whole ledger.
    """
    text = F.lower(F.concat_ws(" ", "project", "main_code", "resource", "source"))
    out = ledger.filter(text.contains(search.lower()))
    if di:
        out = out.filter(F.col("di") == di)
    if source:
        out = out.filter(F.col("source") == source)
    keys = ["project", "main_code", "resource", "source", "di"]
    return out.select(*keys, "total_qty", "total_cost").orderBy(*keys).offset((page - 1) * size).limit(size)


def transaction_months(ledger: DataFrame) -> DataFrame:
    return ledger.select("project", "main_code", "resource", "source", "di", F.inline("months"))


def option_list(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values in order with an explicit ordinal."""
    w = W.partitionBy().orderBy(column)  # distinct option values only
    return rows.select(column).distinct().select(column, F.row_number().over(w).cast("long").alias("ordinal"))


def table_view(rows: DataFrame, search_in: list[str], search: str, equals: dict[str, str], sort: str,
               descending: bool, tie_break: list[str], page: int, size: int) -> DataFrame:
    """Generic table page: search over columns, equality filters, sort and paging."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in search_in]))
    out = rows.filter(text.contains(search.lower()))
    for k, v in equals.items():
        out = out.filter(F.col(k) == v)
    first = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return out.orderBy(first, *tie_break).offset((page - 1) * size).limit(size)


def bridge(model: DataFrame, reallocation: DataFrame) -> DataFrame:
    """Classification bridge: raw direct, + equipment, + other, reported; the gap stays visible."""
    j = model.join(reallocation, model["name"] == reallocation["project"], "left")
    raw = F.col("k_ledger_raw_direct")
    plus_eq = raw + F.coalesce("equipment_total", F.lit(0.0))
    plus_other = plus_eq + F.coalesce("other_cost_total", F.lit(0.0))
    reported = F.col("k_direct_actual")
    levels = [("raw_direct", raw), ("plus_equipment", plus_eq), ("plus_other", plus_other), ("reported", reported)]
    items = [
        F.struct(F.lit(i).alias("level"), F.lit(n).alias("label"), v.alias("value"), (reported - plus_other).alias("gap"))
        for i, (n, v) in enumerate(levels, 1)
    ]
    return j.select("name", F.inline(F.array(*items)))


def waste_efficiency(waste: DataFrame) -> DataFrame:
    """Actual against budget waste share by material."""
    def pick(material: str, col: str) -> Column:
        return F.max(F.when(F.col("material") == material, F.col(col)))

    return waste.groupBy("project").agg(
        pick("steel", "actual_pct").alias("steel_actual"), pick("steel", "budget_pct").alias("steel_budget"),
        pick("concrete", "actual_pct").alias("concrete_actual"), pick("concrete", "budget_pct").alias("concrete_budget"),
    )


def cash_curve(flow: DataFrame) -> DataFrame:
    """Monthly cash with net and cumulative net."""
    z = F.lit(0.0)
    return flow.select(
        "project", "month", "cash_in", "cash_out", "cash_in_cum", "cash_out_cum",
        (F.coalesce("cash_in", z) - F.coalesce("cash_out", z)).alias("net_cash"),
        (F.col("cash_in_cum") - F.col("cash_out_cum")).alias("cumulative_net"),
    )


def stack_columns(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Named columns as (ordinal, label, value) rows."""
    items = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(label).alias("label"), F.col(c).cast("double").alias("value"))
        for i, (label, c) in enumerate(columns.items(), 1)
    ]
    return rows.select(key, F.inline(F.array(*items)))


def headline_kpis(model: DataFrame) -> DataFrame:
    """Ten KPIs in their fallback order; a missing value stays NULL."""
    c = F.coalesce
    ev, ac = c("k_ev_dashboard_scope", "m_earned_value"), c("k_actual_cost_dashboard_scope", "m_actual_cost")
    wide = model.select(
        "name",
        c("k_contract_price_dashboard", "m_contract_value").alias("contract"),
        c("k_total_budget_cost", "m_budget").alias("budget"),
        ev.alias("ev"), ac.alias("ac"), (ev - ac).alias("cv"), ratio(ev, ac).alias("cpi"),
        c("k_direct_actual", "m_direct_cost").alias("direct"),
        c("k_indirect_actual", "m_indirect_cost").alias("indirect"),
        c("k_revenue_gross_profit", "m_revenue").alias("revenue"),
        F.col("k_ledger_accounting_cost").alias("ledger"),
    )
    names = ["contract", "budget", "ev", "ac", "cv", "cpi", "direct", "indirect", "revenue", "ledger"]
    return stack_columns(wide, "name", {n: n for n in names})


def pools_union(granular: DataFrame, official: DataFrame) -> DataFrame:
    cols = ["project", "category", "cost"]
    return granular.select(*cols, F.lit("granular").alias("classification")).unionByName(
        official.select(*cols, F.lit("official").alias("classification"))
    )


def report_tables(tables: dict[str, DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """Six report datasets, each a named set of tables chosen from the normalised ones."""
    # Which tables each report carries.
    contents = {
        "executive": ["kpis", "profitability", "cashflow", "data_quality"],
        "detailed": ["kpis", "profitability", "cashflow", "data_quality", "project_items", "direct_details",
                     "indirect_details", "boq_resources", "boq_forecasts", "waste", "cost_codes"],
        "pack": ["kpis", "profitability", "cashflow", "data_quality", "project_items", "direct_details",
                 "indirect_details", "boq_resources", "boq_forecasts", "waste", "cost_codes", "ledger"],
        "monthly": ["history", "cashflow"],
        "reconciliation": ["scopes", "profitability", "data_quality"],
        "portfolio": ["portfolio_matrix"],
    }
    return {r: {t: tables[t] for t in names if t in tables} for r, names in contents.items()}


def report_manifest(reports: dict[str, dict[str, DataFrame]]) -> DataFrame:
    """Row count of every table of every report; each distinct table is counted once."""
    counts = None
    seen: dict[str, DataFrame] = {}
    for tables in reports.values():
        seen.update(tables)
    for name, df in seen.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    membership = [F.struct(F.lit(r).alias("report"), F.lit(t).alias("t")) for r, ts in reports.items() for t in ts]
    pairs = counts.select("*", F.filter(F.array(*membership), lambda x: x["t"] == F.col("table_name")).alias("m"))
    return pairs.select(F.explode("m.report").alias("report"), "table_name", "row_count")
