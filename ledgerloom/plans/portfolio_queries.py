"""Registered portfolio queries."""

from ledgerloom.functions import inline_table
from ledgerloom.operators import portfolio as op
from ledgerloom.plans import bindings as b
from ledgerloom.plans.bindings import S, sql_with
from ledgerloom.plans.registry import query
from pyspark.sql import functions as F

BASE_COLS = (
    "id,name,period,contract,price,budget,direct_budget,indirect_budget,ev_dashboard,ev_total,ac_dashboard,"
    "ac_total,direct_ac,indirect_ac,ledger,revenue,gp,gp_pct,deductions"
)


def base(spark, sf, lines=None):
    return op.base_rows(b.with_methods(b.project_model(spark, sf, lines)))


def scoped(spark, sf, scope="dashboard", lines=None):
    return op.scoped(base(spark, sf, lines), scope)


@query("p01_project_base", sql_with(f"SELECT {BASE_COLS} FROM base", "base"))
def p01(spark, sf):
    return base(spark, sf).select(*BASE_COLS.split(","))


@query("p02_cost_scope", sql_with("""
SELECT 'dashboard' AS scope, id, ev_dashboard AS ev, ac_dashboard AS ac, ev_dashboard-ac_dashboard AS cv,
 CASE WHEN ac_dashboard<>0 THEN ev_dashboard/ac_dashboard END AS cpi, indirect_budget-indirect_ac AS indirect_var FROM base
UNION ALL SELECT 'total', id, ev_total, ac_total, ev_total-ac_total,
 CASE WHEN ac_total<>0 THEN ev_total/ac_total END, indirect_budget-indirect_ac FROM base""", "base"))
def p02(spark, sf):
    rows = base(spark, sf)
    cols = ["id", "ev", "ac", "cv", "cpi", "indirect_var"]
    one = op.scoped(rows, "dashboard").select(F.lit("dashboard").alias("scope"), *cols)
    return one.unionByName(op.scoped(rows, "total").select(F.lit("total").alias("scope"), *cols))


HEADLINE_SQL = f"""
SELECT *, CASE WHEN ac<>0 THEN ev/ac END AS cpi, ev-ac AS cv, CASE WHEN revenue<>0 THEN gp/revenue END AS gp_ratio FROM
(SELECT count(*) AS projects, {S('contract')} AS contract, {S('budget')} AS budget, {S('ev')} AS ev, {S('ac')} AS ac,
 {S('revenue')} AS revenue, {S('gp')} AS gp, {S('indirect_var')} AS indirect_var FROM scoped FILTERED)"""


@query("p03_headline_kpis", sql_with(HEADLINE_SQL.replace("FILTERED", ""), "scoped"))
def p03(spark, sf):
    return op.headline(scoped(spark, sf))


PICK = ["nation-1", "nation-7", "nation-19"]


@query("p04_project_selection", sql_with(HEADLINE_SQL.replace(
    "FILTERED", "WHERE id IN ('nation-1','nation-7','nation-19')"), "scoped"))
def p04(spark, sf):
    return op.headline(op.select_projects(scoped(spark, sf), PICK))


MATRIX_LONG = " UNION ALL ".join(
    f"SELECT id, name, '{m}' AS metric, CAST({m}{'*100' if m == 'gp_pct' else ''} AS DOUBLE) AS value FROM scoped"
    for m in op.MATRIX_METRICS)
b.define("matrix_long", MATRIX_LONG, "scoped")


@query("p05_cost_matrix", sql_with("""
SELECT metric, highest, high, lowest, low, high-low AS gap, CASE WHEN abs(low)>1e-9 THEN abs(high/low) END AS high_low_ratio FROM
(SELECT metric, max(coalesce(value,0)) AS high, min(coalesce(value,0)) AS low,
 first(name ORDER BY coalesce(value,0) DESC, name) AS highest, first(name ORDER BY coalesce(value,0), name) AS lowest
 FROM matrix_long GROUP BY metric)""", "matrix_long"))
def p05(spark, sf):
    return op.cost_matrix(scoped(spark, sf))


@query("p06_peer_index_share", sql_with(f"""
SELECT l.metric, name, value, abs(value)/top*100 AS peer_index, abs(value)/total*100 AS portfolio_share FROM matrix_long l JOIN
(SELECT metric, greatest(1, max(abs(value))) AS top, greatest(1, {S('abs(value)')}) AS total FROM matrix_long GROUP BY metric) s
ON l.metric=s.metric""", "matrix_long"))
def p06(spark, sf):
    return op.peer_columns(scoped(spark, sf))


NET_CUM = "coalesce(cash_in_cum,0)-coalesce(cash_out_cum,0)"


@query("p07_monthly_comparison", sql_with(
    f"SELECT month, project, {NET_CUM} AS value FROM cashflow", "cashflow"))
def p07(spark, sf):
    return op.month_values(b.cashflow(spark, sf)).filter("metric = 'net_cum'").select("month", "project", "value")


@query("p08_month_coverage", sql_with("""
SELECT month, count(DISTINCT project) AS reporting,
 count(DISTINCT project)=(SELECT count(DISTINCT project) FROM cash) AS common FROM cash GROUP BY month""", "cash"))
def p08(spark, sf):
    return op.month_coverage(b.cash(spark, sf))


@query("p09_pair_difference", sql_with("""
SELECT month, first_value, second_value, first_value-second_value AS difference,
 CASE WHEN first_value-second_value IS NULL THEN NULL WHEN abs(first_value-second_value)<1e-9 THEN 'equal'
  WHEN first_value>second_value THEN 'NATION_3' ELSE 'NATION_4' END AS higher FROM
(SELECT month, max(CASE WHEN project='NATION_3' THEN cash_in END) AS first_value,
 max(CASE WHEN project='NATION_4' THEN cash_in END) AS second_value FROM cash
 WHERE project IN ('NATION_3','NATION_4') GROUP BY month)""", "cash"))
def p09(spark, sf):
    return op.pair_difference(b.cashflow(spark, sf), "cash_in", "NATION_3", "NATION_4")


GRID = [(float(c), float(r), float(i)) for c in (-20, 0, 20, 50) for r in (50, 85, 100, 120) for i in (-20, 0, 60)]
b.define("scenario_sums", f"""SELECT {S('ac')} AS ac, {S('greatest(0, budget-ev)')} AS rem, {S('indirect_ac')} AS ind,
 {S('price')} AS price FROM scoped""", "scoped")
b.define("scenario_grid", "SELECT * FROM (VALUES " + ",".join(
    f"({c}::DOUBLE,{r}::DOUBLE,{i}::DOUBLE)" for c, r, i in GRID) + ") g(cost_stress,revenue_realization,indirect_stress)")
b.define("scenario", """
SELECT *, revenue-eac AS profit, CASE WHEN revenue<>0 THEN (revenue-eac)/revenue ELSE 0 END AS margin FROM
(SELECT cost_stress, revenue_realization, indirect_stress, ac AS current_ac,
 ac + rem*(1+cost_stress/100) + ind*(indirect_stress/100) AS eac, price*(revenue_realization/100) AS revenue
 FROM scenario_grid, scenario_sums)""", "scenario_grid", "scenario_sums")


def scenario(spark, sf):
    grid = inline_table(spark, GRID, ["cost_stress", "revenue_realization", "indirect_stress"])
    return op.scenario_lab(scoped(spark, sf), grid)


@query("p10_scenario_lab", sql_with("SELECT * FROM scenario", "scenario"))
def p10(spark, sf):
    return scenario(spark, sf)


@query("p11_margin_points", sql_with(
    "SELECT name, coalesce(cpi,0) AS x, gp_pct*100 AS y, contract AS size FROM scoped", "scoped"))
def p11(spark, sf):
    return op.margin_points(scoped(spark, sf))


@query("p12_portfolio_cumulative_cash", sql_with("""
SELECT p.project, m.month, cash_in_cum, cash_out_cum FROM (SELECT DISTINCT project FROM cash) p
CROSS JOIN (SELECT DISTINCT month FROM cash) m LEFT JOIN cashflow f ON f.project=p.project AND f.month=m.month""", "cashflow"))
def p12(spark, sf):
    return op.cash_spine(b.cashflow(spark, sf))


METRICS9 = ["contract_value", "budget", "earned_value", "actual_cost", "revenue", "gross_profit"]
QUALITY_SQL = """SELECT n_name AS project, CASE WHEN k>=4 THEN 'critical' WHEN k=3 THEN 'warning' ELSE 'info' END AS severity,
 orderkey, linenumber, k FROM (SELECT l_orderkey orderkey, l_linenumber linenumber, count(*) AS k FROM lineitem
 GROUP BY 1,2 HAVING count(*)>1) JOIN orders ON orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
 JOIN nation ON c_nationkey=n_nationkey"""
b.define("quality", QUALITY_SQL)


def quality(spark, sf):
    """Duplicate-transaction findings per project, graded by how often the key repeats."""
    dup = (b.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("k"))
           .filter("k > 1"))
    return dup.join(b.order_projects(spark, sf), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "project",
        F.when(F.col("k") >= 4, "critical").when(F.col("k") == 3, "warning").otherwise("info").alias("severity"),
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), "k")


@query("p13_portfolio_review_totals", sql_with(
    "SELECT count(*) AS projects, " + ", ".join(f"{S(f'coalesce(m_{m},0)')} AS {m}" for m in METRICS9)
    + ", CAST((SELECT count(*) FROM quality) AS BIGINT) AS quality_findings FROM model", "model", "quality"))
def p13(spark, sf):
    from ledgerloom.functions import total_sum
    sums = b.project_model(spark, sf).agg(
        F.count("*").alias("projects"), *[total_sum(F.coalesce(f"m_{m}", F.lit(0.0))).alias(m) for m in METRICS9])
    return sums.join(quality(spark, sf).agg(F.count("*").alias("quality_findings")), how="cross")


def history(spark, sf, lines=None):
    """Registry rows: current metrics and one history entry per reporting period."""
    hist = b.project_months(spark, sf, lines).select(
        "project", "month", F.sha2(F.concat_ws("|", "project", "month"), 256).alias("fingerprint"), "bac", "ev", "ac")
    return hist.groupBy("project").agg(
        F.max("month").alias("period"),
        F.sort_array(F.collect_list(F.struct("month", "fingerprint", "bac", "ev", "ac"))).alias("history"))


@query("p14_revision_history", sql_with("""
SELECT project, max(month) OVER (PARTITION BY project) AS period, month, sha256(project||'|'||month) AS fingerprint,
 bac AS budget, ev AS earned_value, ac AS actual_cost, ev-ac AS cost_variance, CASE WHEN ac<>0 THEN ev/ac END AS cpi,
 row_number() OVER (PARTITION BY project ORDER BY month) AS ordinal FROM project_months""", "project_months"))
def p14(spark, sf):
    flat = history(spark, sf).select("project", "period", F.posexplode_outer("history").alias("pos", "h"))
    return flat.select(
        "project", "period", "h.month", "h.fingerprint", F.col("h.bac").alias("budget"),
        F.col("h.ev").alias("earned_value"), F.col("h.ac").alias("actual_cost"),
        (F.col("h.ev") - F.col("h.ac")).alias("cost_variance"),
        F.when(F.col("h.ac") != 0, F.col("h.ev") / F.col("h.ac")).alias("cpi"),
        (F.col("pos") + 1).cast("long").alias("ordinal"))


CARDS_SQL = """
SELECT m.name, m.period, m.fingerprint, CASE WHEN m_actual_cost<>0 THEN m_earned_value/m_actual_cost END AS cpi,
 m_earned_value-m_actual_cost AS cost_variance, coalesce(q.findings,0) AS findings, coalesce(q.severe,0) AS severe,
 coalesce(q.warnings,0) AS warnings FROM model m LEFT JOIN (SELECT project, count(*) AS findings,
 count(*) FILTER (severity='critical') AS severe, count(*) FILTER (severity='warning') AS warnings
 FROM quality GROUP BY project) q ON q.project=m.name"""


def cards(spark, sf, lines=None):
    q = quality(spark, sf).groupBy("project").agg(
        F.count("*").alias("findings"), F.count_if(F.col("severity") == "critical").alias("severe"),
        F.count_if(F.col("severity") == "warning").alias("warnings"))
    m = b.project_model(spark, sf, lines)
    return m.join(q, m["name"] == q["project"], "left").select(
        "name", "period", "fingerprint",
        F.when(F.col("m_actual_cost") != 0, F.col("m_earned_value") / F.col("m_actual_cost")).alias("cpi"),
        (F.col("m_earned_value") - F.col("m_actual_cost")).alias("cost_variance"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("findings", "severe", "warnings")])


@query("p15_quality_source_registry", sql_with(
    "SELECT name, period, fingerprint, findings, severe, warnings, "
    "row_number() OVER (ORDER BY findings DESC, name) AS ordinal FROM (" + CARDS_SQL + ")", "model", "quality"))
def p15(spark, sf):
    from pyspark.sql import Window as W
    w = W.partitionBy().orderBy(F.desc("findings"), "name")  # one row per project
    return cards(spark, sf).select(
        "name", "period", "fingerprint", "findings", "severe", "warnings",
        F.row_number().over(w).cast("long").alias("ordinal"))


@query("p16_project_cards", sql_with(
    "SELECT *, CASE WHEN cpi>=1 THEN 'on track' WHEN cpi IS NULL THEN 'unavailable' ELSE 'pressure' END AS signal FROM ("
    + CARDS_SQL + ")", "model", "quality"))
def p16(spark, sf):
    return cards(spark, sf).withColumn(
        "signal", F.when(F.col("cpi") >= 1, "on track").when(F.col("cpi").isNull(), "unavailable").otherwise("pressure"))


@query("p17_available_sums", sql_with(f"""
SELECT *, ev-ac AS cv, CASE WHEN ac<>0 THEN ev/ac END AS cpi FROM (SELECT
 CASE WHEN bool_or(coalesce(k_total_budget_cost,m_budget) IS NOT NULL) THEN {S('budget')} END AS budget,
 CASE WHEN bool_or(coalesce(k_ev_dashboard_scope,m_earned_value) IS NOT NULL) THEN {S('ev_dashboard')} END AS ev,
 CASE WHEN bool_or(coalesce(k_actual_cost_dashboard_scope,m_actual_cost) IS NOT NULL) THEN {S('ac_dashboard')} END AS ac,
 CASE WHEN bool_or(m_gross_profit IS NOT NULL) THEN {S('gp')} END AS gp
 FROM base JOIN model USING (id))""", "base"))
def p17(spark, sf):
    m = b.project_model(spark, sf)
    return op.available_sums(m, op.base_rows(b.with_methods(m)))




@query("p18_latest_cash_completeness", sql_with(f"""
SELECT *, cumulative_cash_in-cumulative_cash_out AS cumulative_net FROM (SELECT count(*) AS projects,
 bool_and(cash_in IS NOT NULL AND cash_out IS NOT NULL) AS complete,
 CASE WHEN bool_and(cash_in IS NOT NULL AND cash_out IS NOT NULL) THEN {S('cash_in')} END AS latest_cash_in,
 CASE WHEN bool_and(cash_in IS NOT NULL AND cash_out IS NOT NULL) THEN {S('cash_out')} END AS latest_cash_out,
 {S('cash_in_cum')} AS cumulative_cash_in, {S('cash_out_cum')} AS cumulative_cash_out
 FROM (SELECT * FROM cashflow QUALIFY row_number() OVER (PARTITION BY project ORDER BY month DESC)=1))""", "cashflow"))
def p18(spark, sf):
    return op.latest_cash(b.cashflow(spark, sf))
