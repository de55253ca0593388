"""Portfolio analytics over one row per project and monthly cash tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import ratio, total_sum

# The selectable matrix metrics.
MATRIX_METRICS = ["contract", "budget", "ev", "ac", "cv", "cpi", "gp_pct", "indirect_var"]
MONTH_METRICS = ["cash_in", "cash_out", "net", "cash_in_cum", "cash_out_cum", "net_cum"]


def first_number(*cols: str) -> Column:
    """First available value of a fallback chain, else 0."""
    return F.coalesce(*[F.col(c) for c in cols], F.lit(0.0))


def revenue_method(methods: DataFrame) -> DataFrame:
    """Per project, the first method whose name holds 'revenue', else the first method."""
    preferred = F.when(F.lower("method").contains("revenue"), 0).otherwise(1)
    pick = F.min_by(F.struct("base", "profit", "profit_pct", "deductions"), F.struct(preferred, "idx"))
    return methods.groupBy("project").agg(pick.alias("r")).select("project", "r.*")


def base_rows(model: DataFrame) -> DataFrame:
    """Project base row: per-field fallback from KPI to registry metric to 0.

    The model row carries its ``methods``: the first whose name holds 'revenue' counts, else the first. No join is needed.
    """
    order = lambda m: F.struct(F.when(F.lower(m["method"]).contains("revenue"), 0).otherwise(1).alias("p"), m["idx"].alias("idx"),
                               *[m[c].alias(c) for c in ("base", "profit", "profit_pct", "deductions")])
    j = model.withColumn("r", F.array_min(F.transform("methods", order))).select(*[c for c in model.columns if c != "methods"], "r.base", "r.profit", "r.profit_pct", "r.deductions")
    chains = {
        "contract": ["k_contract_price_dashboard", "m_contract_value"],
        "price": ["k_total_price_project_summary", "k_contract_price_dashboard", "m_contract_value"],
        "budget": ["k_total_budget_cost", "m_budget"],
        "direct_budget": ["k_direct_budget_cost"],
        "indirect_budget": ["k_indirect_budget_cost"],
        "ev_dashboard": ["k_ev_dashboard_scope", "m_earned_value"],
        "ev_total": ["k_ev_total_project_scope", "k_ev_dashboard_scope", "m_earned_value"],
        "ac_dashboard": ["k_actual_cost_dashboard_scope", "m_actual_cost"],
        "ac_total": ["k_actual_cost_total_project_scope", "k_actual_cost_dashboard_scope", "m_actual_cost"],
        "direct_ac": ["k_direct_actual", "m_direct_cost"],
        "indirect_ac": ["k_indirect_actual", "m_indirect_cost"],
        "ledger": ["k_ledger_accounting_cost"],
        "revenue": ["k_revenue_gross_profit", "base", "m_revenue"],
        "gp": ["profit", "m_gross_profit"],
        "gp_pct": ["profit_pct"],
        "deductions": ["deductions"],
    }
    return j.select(
        "id", "name", "regionkey", "period", "fingerprint",
        *[first_number(*chain).alias(k) for k, chain in chains.items()],
    )


def scoped(base: DataFrame, scope: str = "dashboard") -> DataFrame:
    """Operational scope ('dashboard') or full project scope ('total')."""
    ev, ac = F.col(f"ev_{scope}"), F.col(f"ac_{scope}")
    return base.select(
        "*",
        ev.alias("ev"),
        ac.alias("ac"),
        (ev - ac).alias("cv"),
        ratio(ev, ac).alias("cpi"),
        (F.col("indirect_budget") - F.col("indirect_ac")).alias("indirect_var"),
    )


def headline(rows: DataFrame) -> DataFrame:
    """Sums over the selection; ratios are ratios of sums."""
    names = ["contract", "budget", "ev", "ac", "revenue", "gp", "indirect_var"]
    return rows.agg(F.count("*").alias("projects"), *[total_sum(n).alias(n) for n in names]).select(
        "*",
        ratio("ev", "ac").alias("cpi"),
        (F.col("ev") - F.col("ac")).alias("cv"),
        ratio("gp", "revenue").alias("gp_ratio"),
    )


def select_projects(rows: DataFrame, ids: list[str]) -> DataFrame:
    """The named projects; at least one has to be named."""
    if not ids:
        raise ValueError("a selection names at least one project")
    return rows.filter(F.col("id").isin(ids))


def matrix_long(rows: DataFrame) -> DataFrame:
    """project x metric values; the percent metric is scaled by 100."""
    values = [
        F.struct(F.lit(m).alias("metric"), (F.col(m) * 100 if m == "gp_pct" else F.col(m)).cast("double").alias("value"))
        for m in MATRIX_METRICS
    ]
    return rows.select("id", "name", F.inline(F.array(*values)))


def cost_matrix(rows: DataFrame) -> DataFrame:
    """Per metric: highest and lowest project, gap and high/low ratio (NULL near zero)."""
    v = F.coalesce("value", F.lit(0.0))
    order_hi = F.struct((-v).alias("a"), F.col("name"))
    order_lo = F.struct(v.alias("a"), F.col("name"))
    return (
        matrix_long(rows)
        .groupBy("metric")
        .agg(
            F.min_by("name", order_hi).alias("highest"),
            F.max(v).alias("high"),
            F.min_by("name", order_lo).alias("lowest"),
            F.min(v).alias("low"),
        )
        .select(
            "metric", "highest", "high", "lowest", "low",
            (F.col("high") - F.col("low")).alias("gap"),
            F.when(F.abs("low") > 1e-9, F.abs(F.col("high") / F.col("low"))).alias("high_low_ratio"),
        )
    )


def peer_columns(rows: DataFrame) -> DataFrame:
    """Value, peer index and portfolio share of every project and metric."""
    long = matrix_long(rows)
    stats = long.groupBy("metric").agg(
        F.greatest(F.lit(1.0), F.max(F.abs("value"))).alias("top"),
        F.greatest(F.lit(1.0), total_sum(F.abs("value"))).alias("total"),
    )
    return long.join(stats, "metric").select(
        "metric", "name", "value",
        (F.abs("value") / F.col("top") * 100).alias("peer_index"),
        (F.abs("value") / F.col("total") * 100).alias("portfolio_share"),
    )


def month_values(flow: DataFrame) -> DataFrame:
    """project x month x metric; net treats a missing side as 0."""
    z = F.lit(0.0)
    exprs = {
        "cash_in": F.col("cash_in"),
        "cash_out": F.col("cash_out"),
        "net": F.coalesce("cash_in", z) - F.coalesce("cash_out", z),
        "cash_in_cum": F.col("cash_in_cum"),
        "cash_out_cum": F.col("cash_out_cum"),
        "net_cum": F.coalesce("cash_in_cum", z) - F.coalesce("cash_out_cum", z),
    }
    items = [F.struct(F.lit(m).alias("metric"), exprs[m].alias("value")) for m in MONTH_METRICS]
    return flow.select("project", "month", F.inline(F.array(*items)))


def monthly_comparison(flow: DataFrame, metric: str, projects: list[str]) -> DataFrame:
    """Months as rows, the named projects as columns."""
    return (
        month_values(flow)
        .filter(F.col("metric") == metric)
        .groupBy("month")
        .pivot("project", projects)
        .agg(F.first("value"))
    )


def month_coverage(flow: DataFrame) -> DataFrame:
    """Every month with the number of projects reporting it and whether all do."""
    n = flow.agg(F.countDistinct("project").alias("n_projects"))
    return (
        flow.groupBy("month").agg(F.countDistinct("project").alias("reporting"))
        .join(n, how="cross")
        .select("month", "reporting", (F.col("reporting") == F.col("n_projects")).alias("common"))
    )


def pair_difference(flow: DataFrame, metric: str, first: str, second: str) -> DataFrame:
    """Month by month difference of two projects and the label of the higher one."""
    wide = monthly_comparison(flow.filter(F.col("project").isin(first, second)), metric, [first, second])
    a, b = F.col(f"`{first}`"), F.col(f"`{second}`")
    diff = a - b
    return wide.select(
        "month", a.alias("first_value"), b.alias("second_value"), diff.alias("difference"),
        F.when(diff.isNull(), None).when(F.abs(diff) < 1e-9, "equal").when(diff > 0, first).otherwise(second).alias("higher"),
    )


def scenario_lab(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """EAC, revenue, profit and margin for each (cost, revenue, indirect) stress triple.

    The portfolio part is aggregated once; the grid multiplies only that one row.
    """
    rem = F.greatest(F.lit(0.0), F.col("budget") - F.col("ev"))
    sums = rows.agg(
        total_sum("ac").alias("ac"), total_sum(rem).alias("rem"),
        total_sum("indirect_ac").alias("ind"), total_sum("price").alias("price"),
    )
    eac = F.col("ac") + F.col("rem") * (1 + F.col("cost_stress") / 100) + F.col("ind") * (F.col("indirect_stress") / 100)
    out = grid.join(sums, how="cross").select(
        "cost_stress", "revenue_realization", "indirect_stress",
        F.col("ac").alias("current_ac"), eac.alias("eac"),
        (F.col("price") * (F.col("revenue_realization") / 100)).alias("revenue"),
    )
    profit = F.col("revenue") - F.col("eac")
    return out.select(
        "*", profit.alias("profit"),
        F.when(F.col("revenue") != 0, profit / F.col("revenue")).otherwise(F.lit(0.0)).alias("margin"),
    )


def margin_points(rows: DataFrame) -> DataFrame:
    return rows.select(
        "name", F.coalesce("cpi", F.lit(0.0)).alias("x"), (F.col("gp_pct") * 100).alias("y"), F.col("contract").alias("size")
    )


def cash_spine(flow: DataFrame) -> DataFrame:
    """Cumulative cash of every project on the union of all months, gaps kept NULL."""
    spine = flow.select("month").distinct().join(flow.select("project").distinct(), how="cross")
    return spine.join(flow.select("project", "month", "cash_in_cum", "cash_out_cum"), ["project", "month"], "left")


def available_sums(model: DataFrame, base: DataFrame) -> DataFrame:
    """Sums that stay NULL when no project carries the metric."""
    flags = model.select(
        F.col("id").alias("_id"),
        F.coalesce("k_total_budget_cost", "m_budget").isNotNull().alias("has_budget"),
        F.coalesce("k_ev_dashboard_scope", "m_earned_value").isNotNull().alias("has_ev"),
        F.coalesce("k_actual_cost_dashboard_scope", "m_actual_cost").isNotNull().alias("has_ac"),
        F.col("m_gross_profit").isNotNull().alias("has_gp"),
    )
    j = base.join(flags, F.col("id") == F.col("_id"))
    pairs = {"budget": "budget", "ev": "ev_dashboard", "ac": "ac_dashboard", "gp": "gp"}
    out = j.agg(*[F.when(F.bool_or(f"has_{k}"), total_sum(c)).alias(k) for k, c in pairs.items()])
    return out.select("*", (F.col("ev") - F.col("ac")).alias("cv"), ratio("ev", "ac").alias("cpi"))


def latest_cash(flow: DataFrame) -> DataFrame:
    """Portfolio latest cash, only when every project has both latest values."""
    last = flow.groupBy("project").agg(
        F.max_by(F.struct("cash_in", "cash_out", "cash_in_cum", "cash_out_cum"), "month").alias("l")
    )
    both = F.bool_and(F.col("l.cash_in").isNotNull() & F.col("l.cash_out").isNotNull())
    both_cum = F.bool_and(F.col("l.cash_in_cum").isNotNull() & F.col("l.cash_out_cum").isNotNull())
    out = last.agg(
        F.count("*").alias("projects"), both.alias("complete"),
        F.when(both, total_sum("l.cash_in")).alias("latest_cash_in"),
        F.when(both, total_sum("l.cash_out")).alias("latest_cash_out"),
        F.when(both_cum, total_sum("l.cash_in_cum")).alias("cumulative_cash_in"),
        F.when(both_cum, total_sum("l.cash_out_cum")).alias("cumulative_cash_out"),
    )
    return out.select("*", (F.col("cumulative_cash_in") - F.col("cumulative_cash_out")).alias("cumulative_net"))
