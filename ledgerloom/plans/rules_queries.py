"""Registered assessment rules."""

from pyspark.sql import functions as F

from ledgerloom.functions import ratio, total_sum
from ledgerloom.operators import normalize as nz
from ledgerloom.operators import project as pj
from ledgerloom.operators import rules as op
from ledgerloom.plans import bindings as b
from ledgerloom.plans.bindings import S, sql_with
from ledgerloom.plans.normalize_queries import forecasts
from ledgerloom.plans.portfolio_queries import quality, scenario
from ledgerloom.plans.project_queries import reallocation, resource_concentration, waste
from ledgerloom.plans.registry import query

P = op.DEFAULT_POLICY
C = F.col

# Candidate policies: one per supplier, thresholds shifted by its key.
POLICY_SHIFTS = {
    "cpi_caution": "CAST(90 + s_suppkey % 20 AS DOUBLE) / 100", "waste_critical_points": "(s_suppkey % 7) * 1.0",
    "reconciliation_critical_pct": "(s_suppkey % 9) * 1.0", "minimum_trend_periods": "(s_suppkey % 5) * 1.0",
    "trend_r_squared_caution_floor": "CAST(s_suppkey % 15 AS DOUBLE) / 10",
}


def _policy_sql(k):
    if k == "concentration_critical_pct":
        return "CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 40.0::DOUBLE END"
    return f"CAST({POLICY_SHIFTS.get(k, P[k])} AS DOUBLE)"


@query("r01_policy_validation", sql_with(f"""
SELECT s_suppkey, CASE WHEN concentration_critical_pct IS NOT NULL AND cpi_caution<=cpi_favorable
 AND reconciliation_caution_pct<=reconciliation_critical_pct AND cash_deficit_caution_pct<=cash_deficit_critical_pct
 AND concentration_caution_pct<=concentration_critical_pct AND waste_caution_points<=waste_critical_points AND minimum_trend_periods>=2
 AND trend_r_squared_caution_floor BETWEEN 0 AND 1 AND trend_anomaly_caution_z>0
 AND trend_anomaly_caution_z<=trend_anomaly_critical_z THEN 'valid' ELSE 'rejected' END AS status
FROM (SELECT s_suppkey, {', '.join(f'{_policy_sql(k)} AS {k}' for k in P)} FROM supplier)"""))
def r01(spark, sf):
    cols = {k: F.expr(f"CAST({POLICY_SHIFTS[k]} AS DOUBLE)") if k in POLICY_SHIFTS else F.lit(v) for k, v in P.items()}
    cols["concentration_critical_pct"] = F.expr("CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 40D END")
    return b.table(spark, sf, "supplier").select(
        "s_suppkey", F.when(op.valid_policy(cols), "valid").otherwise("rejected").alias("status"))


ANSWERS = {
    "cpi_critical": "CAST(85 + c_custkey % 20 AS DOUBLE) / 100", "adverse_variance_pct": "(c_custkey % 13) * 10.0 - 5.0",
    "minimum_margin_pct": "(c_custkey % 5) * 4.0", "cash_deficit_pct": "(c_custkey % 8) * 4.0",
    "concentration_pct": "20.0 + (c_custkey % 6) * 5.0", "reconciliation_pct": "(c_custkey % 4) * 2.0",
}


@query("r02_answers_to_policy", f"""
SELECT *, CASE WHEN status='accepted' THEN cpi_critical END AS cpi_caution, CASE WHEN status='accepted' THEN -abs(adverse_variance_pct) END AS cv_caution_pct,
 CASE WHEN status='accepted' THEN minimum_margin_pct END AS margin_target_pct,
 CASE WHEN status='accepted' THEN cash_deficit_pct END AS cash_deficit_critical_pct FROM (SELECT *, CASE WHEN cpi_critical>0 AND cpi_critical<=1
 AND adverse_variance_pct BETWEEN 0 AND 100 AND minimum_margin_pct BETWEEN -100 AND 100 AND cash_deficit_pct BETWEEN 5 AND 100
 AND concentration_pct BETWEEN 25 AND 100 AND reconciliation_pct BETWEEN 1 AND 100 THEN 'accepted' ELSE 'rejected' END AS status
 FROM (SELECT c_custkey, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in ANSWERS.items())} FROM customer))""")
def r02(spark, sf):
    answers = b.table(spark, sf, "customer").selectExpr(
        "c_custkey", *[f"CAST({v} AS DOUBLE) AS {k}" for k, v in ANSWERS.items()])
    return op.policies_from_answers(answers)


COST_RULE = """CASE WHEN (ev=0 AND ac=0) OR (cpi IS NULL AND cv IS NULL) THEN 'unavailable'
 WHEN cpi<0.95 OR (CASE WHEN ev<>0 THEN cv/abs(ev)*100 END)<-5 THEN 'critical'
 WHEN cpi<1 OR (CASE WHEN ev<>0 THEN cv/abs(ev)*100 END)<0 THEN 'caution' ELSE 'favorable' END"""
b.define("wp", f"""SELECT *, CASE WHEN ac<>0 THEN ev/ac END AS cpi, ev-ac AS cv FROM
 (SELECT project, main_code, month, {S('bac')} AS bac, {S('ev')} AS ev, {S('ac')} AS ac, count(*) AS n FROM cost_lines GROUP BY 1,2,3)""", "cost_lines")


def wp(spark, sf):
    g = b.cost_lines(spark, sf, part=True).groupBy("project", "main_code", "month").agg(
        *b.money_sums("bac", "ev", "ac"), F.count("*").alias("n"))
    return g.select("*", ratio("ev", "ac").alias("cpi"), (C("ev") - C("ac")).alias("cv"))


@query("r03_evidence_guard", sql_with(f"""
SELECT project, main_code, month, CASE WHEN least(1.0,n/4.0)<0.5 OR n%5=0 THEN 'unavailable' ELSE {COST_RULE} END AS status,
 CASE WHEN least(1.0,n/4.0)<0.5 OR n%5=0 THEN 0.0 WHEN {COST_RULE}='unavailable' THEN 0.0 ELSE CAST(least(1.0,n/4.0) AS DOUBLE) END AS confidence FROM wp""", "wp"))
def r03(spark, sf):
    # Every package of five lines stands for one without metrics; confidence grows with the line count.
    known = C("n") % 5 != 0
    d = wp(spark, sf).select(
        "project", "main_code", "month", F.lit("cost_performance").alias("semantic_type"),
        F.least(F.lit(1.0), C("n") / 4).alias("confidence"),
        F.create_map(F.lit("ev"), F.when(known, C("ev")), F.lit("ac"), F.when(known, C("ac"))).alias("metrics"))
    return op.evaluate(d).select("project", "main_code", "month", "status", C("result_confidence").alias("confidence"))


@query("r04_cost_performance", sql_with(f"SELECT project, main_code, month, ev, ac, cpi, cv, {COST_RULE} AS status FROM wp", "wp"))
def r04(spark, sf):
    return wp(spark, sf).select(
        "project", "main_code", "month", "ev", "ac", "cpi", "cv",
        op.cost_performance(C("ev"), C("ac"), C("cpi"), C("cv")).alias("status"))


b.define("method_counts", """SELECT project, count(*) AS methods, count(*) FILTER (profit<0 OR profit_pct<0) AS losses,
 count(*) FILTER (profit_pct IS NULL OR profit_pct*100<0) AS misses FROM methods WHERE profit IS NOT NULL OR profit_pct IS NOT NULL GROUP BY 1""", "methods")


@query("r05_profitability_methods", sql_with("""
SELECT *, CASE WHEN losses=methods THEN 'critical' WHEN losses>0 THEN 'mixed' WHEN misses=methods THEN 'caution'
 WHEN misses>0 THEN 'mixed' ELSE 'favorable' END AS status FROM method_counts""", "method_counts"))
def r05(spark, sf):
    counts = op.method_counts(b.profit_methods(b.project_model(spark, sf)))
    return counts.withColumn("status", op.profitability_methods(C("methods"), C("losses"), C("misses")))


PROFIT_RULE = """CASE WHEN profit IS NULL AND margin IS NULL THEN 'unavailable' WHEN profit<0 OR margin*100<0 THEN 'critical'
 WHEN margin IS NULL OR margin*100<TARGET THEN 'caution' ELSE 'favorable' END"""


@query("r06_profitability", sql_with(
    "SELECT project, idx, profit, profit_pct AS margin, "
    + PROFIT_RULE.replace("margin", "profit_pct").replace("TARGET", "25") + " AS status FROM methods", "methods"))
def r06(spark, sf):
    policy = {**P, "margin_target_pct": 25.0}
    m = b.profit_methods(b.project_model(spark, sf))
    return m.select("project", "idx", "profit", C("profit_pct").alias("margin"),
                    op.profitability(C("profit"), C("profit_pct"), policy).alias("status"))


DEFICIT = "CASE WHEN net<0 THEN CASE WHEN cin<>0 THEN abs(net)/abs(cin)*100 WHEN cout>0 THEN 100 ELSE 0 END ELSE 0 END"
CASH_RULE = f"""CASE WHEN (net IS NULL AND cin IS NULL AND cout IS NULL) OR (cin=0 AND cout=0 AND net=0) THEN 'unavailable'
 WHEN {DEFICIT}>=15 THEN 'critical' WHEN net<0 OR neg>0 THEN 'caution' ELSE 'favorable' END"""


@query("r07_cash_position", sql_with(f"""
SELECT project, month, 'cashflow' AS kind, {CASH_RULE} AS status FROM (SELECT project, month, cash_in AS cin, cash_out AS cout, cash_in-cash_out AS net, 0 AS neg FROM cashflow)
UNION ALL SELECT project, month, 'cumulative_cashflow', {CASH_RULE} FROM (SELECT project, month, cash_in_cum AS cin, cash_out_cum AS cout,
 cash_in_cum-cash_out_cum AS net, 0 AS neg FROM cashflow)""", "cashflow"))
def r07(spark, sf):
    f = b.cashflow(spark, sf)
    zero = F.lit(0)
    kinds = F.array(
        F.struct(F.lit("cashflow").alias("kind"), op.cash(C("cash_in"), C("cash_out"), C("cash_in") - C("cash_out"), zero).alias("status")),
        F.struct(F.lit("cumulative_cashflow").alias("kind"),
                 op.cash(C("cash_in_cum"), C("cash_out_cum"), C("cash_in_cum") - C("cash_out_cum"), zero).alias("status")))
    return f.select("project", "month", F.inline(kinds))


b.define("points", """SELECT project, month, cash_in_cum, cash_out_cum, cash_in_cum-cash_out_cum AS net,
 CAST(row_number() OVER (PARTITION BY project ORDER BY month)-1 AS DOUBLE) AS x FROM cashflow""", "cashflow")
b.define("trend_line", """SELECT project, count(*) AS periods, regr_slope(net,x) AS slope, regr_intercept(net,x) AS intercept,
 CASE WHEN var_pop(net)=0 THEN 1 ELSE greatest(0,least(1,regr_r2(net,x))) END AS r_squared, arg_max(net,month) AS last_net,
 arg_max(cash_in_cum,month) AS latest_cash_in, arg_max(cash_out_cum,month) AS latest_cash_out FROM points GROUP BY project""", "points")
b.define("trend", """SELECT l.project, periods, slope, intercept, r_squared, slope*periods+intercept AS forecast_next_net,
 CASE WHEN sd<>0 THEN greatest(abs((hi-mu)/sd),abs((lo-mu)/sd)) ELSE 0 END AS max_residual_z, last_net, latest_cash_in, latest_cash_out
 FROM trend_line l JOIN (SELECT project, avg(r) AS mu, stddev_pop(r) AS sd, max(r) AS hi, min(r) AS lo FROM
 (SELECT p.project, net-(slope*x+intercept) AS r FROM points p JOIN trend_line t ON t.project=p.project) GROUP BY project) s ON s.project=l.project""",
         "trend_line")


@query("r08_cash_trend_metrics", sql_with("""
SELECT project, periods, round(slope,2) AS slope, round(intercept,2) AS intercept, round(r_squared,6) AS r_squared,
 round(forecast_next_net,2) AS forecast_next_net, round(max_residual_z,6) AS max_residual_z, last_net, latest_cash_in, latest_cash_out FROM trend""", "trend"))
def r08(spark, sf):
    t = op.cash_trend_metrics(b.cashflow(spark, sf))
    return t.select(
        "project", "periods", *[F.round(c, n).alias(c) for c, n in (
            ("slope", 2), ("intercept", 2), ("r_squared", 6), ("forecast_next_net", 2), ("max_residual_z", 6))],
        "last_net", "latest_cash_in", "latest_cash_out")


TREND_RULE = """CASE WHEN periods<3 THEN 'unavailable' WHEN slope IS NULL OR r_squared IS NULL OR last_net IS NULL THEN 'unavailable'
 WHEN last_net<0 THEN CASE WHEN (CASE WHEN latest_cash_in<>0 THEN abs(last_net)/abs(latest_cash_in)*100 WHEN latest_cash_out>0 THEN 100 ELSE 0 END)>=15 THEN 'critical' ELSE 'caution' END
 WHEN forecast_next_net<0 THEN 'critical' WHEN slope<0 OR r_squared<0.5 OR max_residual_z>=2 THEN 'caution' ELSE 'favorable' END"""


def trend_status(p="periods"):
    return op.cash_trend(C(p), C("slope"), C("r_squared"), C("forecast_next_net"), C("last_net"), C("max_residual_z"),
                         C("latest_cash_in"), C("latest_cash_out"))


@query("r09_cash_trend_rule", sql_with(f"SELECT project, periods, {TREND_RULE} AS status FROM trend", "trend"))
def r09(spark, sf):
    return op.cash_trend_metrics(b.cashflow(spark, sf)).select("project", "periods", trend_status().alias("status"))


WASTE_RULE = """CASE WHEN greatest((steel_actual-steel_budget)*100,(concrete_actual-concrete_budget)*100) IS NULL THEN 'unavailable'
 WHEN greatest((steel_actual-steel_budget)*100,(concrete_actual-concrete_budget)*100)>3 THEN 'critical'
 WHEN greatest((steel_actual-steel_budget)*100,(concrete_actual-concrete_budget)*100)>1 THEN 'caution' ELSE 'favorable' END"""


@query("r10_waste_rule", sql_with(f"SELECT *, {WASTE_RULE} AS status FROM waste_wide", "waste_wide"))
def r10(spark, sf):
    w = pj.waste_efficiency(waste(spark, sf))
    return w.withColumn("status", op.waste(C("steel_actual"), C("steel_budget"), C("concrete_actual"), C("concrete_budget")))


REC_GAP = "abs(coalesce(CASE WHEN reported<>0 THEN (accounting-reported)/abs(reported)*100 END,0))"
REC_RULE = f"""CASE WHEN accounting IS NULL OR reported IS NULL OR (accounting=0 AND reported=0) THEN 'unavailable'
 WHEN {REC_GAP}>5 THEN 'critical' WHEN {REC_GAP}>1 THEN 'caution' ELSE 'favorable' END"""


@query("r11_reconciliation_rule", sql_with(f"""
SELECT name, basis, accounting, reported, {REC_RULE} AS status FROM (
 SELECT name, 'dashboard' AS basis, k_ledger_accounting_cost AS accounting, k_actual_cost_dashboard_scope AS reported FROM model
 UNION ALL SELECT name, 'registry', k_ledger_accounting_cost, m_actual_cost FROM model
 UNION ALL SELECT name, 'full', k_ledger_accounting_cost, k_actual_cost_total_project_scope FROM model
 UNION ALL SELECT name, 'direct', k_ledger_accounting_cost, k_direct_actual FROM model)""", "model"))
def r11(spark, sf):
    bases = {"dashboard": "k_actual_cost_dashboard_scope", "registry": "m_actual_cost",
             "full": "k_actual_cost_total_project_scope", "direct": "k_direct_actual"}
    rows = F.array(*[F.struct(F.lit(k).alias("basis"), C("k_ledger_accounting_cost").alias("accounting"), C(v).alias("reported"))
                     for k, v in bases.items()])
    return b.project_model(spark, sf).select("name", F.inline(rows)).withColumn(
        "status", op.reconciliation(C("accounting"), C("reported")))


CONC_RULE = """CASE WHEN top IS NULL OR total IS NULL OR total=0 OR top<=0 OR total<=0 OR top>total THEN 'unavailable'
 WHEN abs(top)/abs(total)*100>40 THEN 'critical' WHEN abs(top)/abs(total)*100>25 THEN 'caution' ELSE 'favorable' END"""


@query("r12_concentration_rule", sql_with(f"""
SELECT *, {CONC_RULE} AS status FROM (SELECT project, 'resource' AS basis, row_count, total, top FROM conc UNION ALL
 SELECT project, 'package', count(*), {S('v')}, max(v) FROM (SELECT project, division, {S('ac')} AS v FROM direct_details GROUP BY 1,2) GROUP BY 1
 UNION ALL SELECT project, 'source', count(*), {S('v')}, max(v) FROM (SELECT project, source, {S('total_cost')} AS v FROM ledger GROUP BY 1,2) GROUP BY 1)""",
                                       "conc", "direct_details", "ledger"))
def r12(spark, sf):
    lines = b.cost_cube(spark, sf, package="main_code division raw_di", resource="main_code resource source raw_di")
    by_res = pj.concentration(b.boq_resources(spark, sf, lines["resource"]), ["project"], C("resource"), C("actual_cost")).select(
        "project", F.lit("resource").alias("basis"), "row_count", "total", "top")
    d = pj.concentration(b.direct_details(spark, sf, lines["package"]), ["project"], C("division"), C("ac"))
    s = pj.concentration(b.ledger_totals(spark, sf, lines["resource"]), ["project"], C("source"), C("total_cost"))
    rows = (by_res.unionByName(d.withColumn("basis", F.lit("package"))).unionByName(s.withColumn("basis", F.lit("source"))))
    return rows.withColumn("status", op.concentration(C("top"), C("total")))


b.define("forecast_sums", f"""SELECT project, count(*) AS row_count, {S('bac')} AS bac, {S('ev')} AS ev, {S('etc')} AS etc,
 {S('remaining_budget')} AS remaining_budget FROM forecasts GROUP BY project""", "forecasts")
FC_RULE = """CASE WHEN coalesce(row_count,0)=0 THEN 'unavailable' WHEN remaining_budget-etc IS NULL THEN 'informational'
 WHEN remaining_budget-etc<0 AND (CASE WHEN coalesce(bac,0)<>0 THEN (remaining_budget-etc)/abs(bac)*100 END)<-5 THEN 'critical'
 WHEN remaining_budget-etc<0 THEN 'caution' ELSE 'favorable' END"""


def forecast_sums(rows):
    return rows.groupBy("project").agg(
        F.count("*").alias("row_count"), *[total_sum(c).alias(c) for c in ("bac", "ev", "etc", "remaining_budget")])


@query("r13_forecast_rule", sql_with(f"""
SELECT *, 'all' AS basis, {FC_RULE} AS status FROM forecast_sums UNION ALL
SELECT *, 'direct', {FC_RULE} FROM (SELECT project, count(*) AS row_count, {S('bac')} AS bac, {S('ev')} AS ev, {S('etc')} AS etc,
 {S('remaining_budget')} AS remaining_budget FROM forecasts WHERE NOT is_resource GROUP BY project)""", "forecast_sums"))
def r13(spark, sf):
    rows = forecasts(spark, sf)
    both = forecast_sums(rows).withColumn("basis", F.lit("all")).unionByName(
        forecast_sums(rows.filter("NOT is_resource")).withColumn("basis", F.lit("direct")))
    return both.withColumn("status", op.forecast(C("row_count"), C("remaining_budget"), C("etc"), C("bac")))


IND_RULE = """CASE WHEN budget IS NULL OR actual IS NULL OR budget<=0 THEN 'unavailable' WHEN variance/abs(budget)*100<-5 THEN 'critical'
 WHEN variance/abs(budget)*100<0 THEN 'caution' ELSE 'favorable' END"""


@query("r14_indirect_variance_rule", sql_with(f"""
SELECT project, main_code, budget, actual, variance, {IND_RULE} AS status FROM (
 SELECT project, main_code, bac AS budget, ac AS actual, bac-ac AS variance FROM indirect_details
 UNION ALL SELECT name, 'ALL', k_indirect_budget_cost, k_indirect_actual, k_indirect_budget_cost-k_indirect_actual FROM model)""",
                                           "indirect_details", "model"))
def r14(spark, sf):
    codes = b.indirect_details(spark, sf).select("project", "main_code", C("bac").alias("budget"), C("ac").alias("actual"))
    whole = b.project_model(spark, sf).select(
        C("name").alias("project"), F.lit("ALL").alias("main_code"), C("k_indirect_budget_cost").alias("budget"),
        C("k_indirect_actual").alias("actual"))
    rows = codes.unionByName(whole).withColumn("variance", C("budget") - C("actual"))
    return rows.withColumn("status", op.indirect_variance(C("budget"), C("actual"), C("variance")))


b.define("quality_counts", """SELECT name AS project, count(q.project) AS findings, count(*) FILTER (severity='critical') AS severe,
 count(*) FILTER (severity='warning') AS warnings FROM model LEFT JOIN quality q ON q.project=model.name GROUP BY name""", "model", "quality")


def quality_counts(spark, sf, projects, found=None):
    q = (found if found is not None else quality(spark, sf)).groupBy("project").agg(
        F.count("*").alias("findings"), F.count_if(C("severity").isin("critical", "error")).alias("severe"),
        F.count_if(C("severity") == "warning").alias("warnings"))
    j = projects.select(C("name").alias("project")).join(q, "project", "left")
    return j.select("project", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("findings", "severe", "warnings")])


@query("r15_data_quality_rule", sql_with(
    "SELECT *, CASE WHEN severe>0 THEN 'critical' WHEN warnings>0 THEN 'caution' ELSE 'favorable' END AS status FROM quality_counts",
    "quality_counts"))
def r15(spark, sf):
    q = quality_counts(spark, sf, b.project_model(spark, sf))
    return q.withColumn("status", op.data_quality(C("severe"), C("warnings"), F.lit(0)))


@query("r16_scenario_rule", sql_with(
    "SELECT cost_stress, revenue_realization, indirect_stress, profit, margin, "
    + PROFIT_RULE.replace("TARGET", "20").replace("margin IS NULL OR ", "") + " AS status FROM scenario", "scenario"))
def r16(spark, sf):
    s = scenario(spark, sf)
    return s.select("cost_stress", "revenue_realization", "indirect_stress", "profit", "margin",
                    op.scenario(C("profit"), C("margin"), {**P, "margin_target_pct": 20.0}).alias("status"))


b.define("ledger_month_stats", f"""SELECT project, count(*) AS periods, arg_min(total,month) AS first_total, arg_max(total,month) AS last_total,
 {S('total')} AS total FROM (SELECT project, month, {S('ac')} AS total FROM cost_lines GROUP BY 1,2) GROUP BY 1""", "cost_lines")


def ledger_month_stats(months):
    return months.groupBy("project").agg(
        F.count("*").alias("periods"), F.min_by("total", "month").alias("first_total"),
        F.max_by("total", "month").alias("last_total"), total_sum("total").alias("total"))


@query("r17_ledger_trend_rule", sql_with("""
SELECT project, periods, first_total, last_total, CASE WHEN periods<3 THEN 'unavailable' ELSE 'informational' END AS status,
 CASE WHEN last_total>first_total THEN 'up' WHEN last_total<first_total THEN 'down' ELSE 'flat' END AS direction FROM ledger_month_stats""",
                                      "ledger_month_stats"))
def r17(spark, sf):
    months = b.cost_lines(spark, sf).groupBy("project", "month").agg(b.line_sum("ac").alias("total"))
    s = ledger_month_stats(months)
    return s.select("project", "periods", "first_total", "last_total", op.ledger_trend(C("periods")).alias("status"),
                    op.direction(C("first_total"), C("last_total")).alias("direction"))


@query("r18_no_target_safeguard", sql_with(f"""
SELECT project, source AS component, 'informational' AS status, {S('total_cost')} AS value FROM ledger GROUP BY 1,2
UNION ALL SELECT project, 'inventory', 'informational', CAST(count(*) AS DOUBLE) FROM ledger GROUP BY 1""", "ledger"))
def r18(spark, sf):
    led = b.ledger_totals(spark, sf)
    rows = led.groupBy("project", C("source").alias("component")).agg(total_sum("total_cost").alias("value")).withColumn(
        "semantic_type", F.lit("cost_mix"))
    inv = led.groupBy("project").agg(F.count("*").cast("double").alias("value")).select(
        "project", F.lit("inventory").alias("component"), "value", F.lit("inventory").alias("semantic_type"))
    d = rows.unionByName(inv).withColumn("metrics", F.create_map(F.lit("value"), C("value"))).withColumn("confidence", F.lit(0.86))
    return op.evaluate(d).select("project", "component", "status", "value")


@query("r22_severity_ordering", sql_with(f"""
SELECT project, main_code, status, row_number() OVER (PARTITION BY project ORDER BY
 CASE status WHEN 'critical' THEN 1 WHEN 'caution' THEN 2 WHEN 'mixed' THEN 3 WHEN 'favorable' THEN 4 WHEN 'informational' THEN 5 ELSE 6 END, main_code) AS ordinal
FROM (SELECT project, main_code, {COST_RULE} AS status FROM (SELECT *, CASE WHEN ac<>0 THEN ev/ac END AS cpi, ev-ac AS cv FROM
 (SELECT project, main_code, {S('ev')} AS ev, {S('ac')} AS ac FROM cost_lines GROUP BY 1,2)))""", "cost_lines"))
def r22(spark, sf):
    from pyspark.sql import Window as W
    g = b.cost_lines(spark, sf, part=True).groupBy("project", "main_code").agg(*b.money_sums("ev", "ac"))
    status = op.cost_performance(C("ev"), C("ac"), ratio("ev", "ac"), C("ev") - C("ac"))
    w = W.partitionBy("project").orderBy(op.status_rank("status"), "main_code")  # one row per work code
    return g.select("project", "main_code", status.alias("status")).withColumn(
        "ordinal", F.row_number().over(w).cast("long"))


@query("r26_status_distribution", sql_with(f"""
SELECT status, count(*) AS n, count(*)/sum(count(*)) OVER () AS share FROM (SELECT {COST_RULE} AS status FROM wp) GROUP BY status""", "wp"))
def r26(spark, sf):
    st = wp(spark, sf).select(op.cost_performance(C("ev"), C("ac"), C("cpi"), C("cv")).alias("status"))
    return pj_share(st)


def pj_share(st):
    """Count and share per status; the total is taken over the few status rows."""
    from pyspark.sql import Window as W
    g = st.groupBy("status").agg(F.count("*").alias("n"))
    return g.select("status", "n", (C("n") / F.sum("n").over(W.partitionBy())).alias("share"))


# --------------------------------------------------- batch reading variants

b.define("raw_conc", f"""SELECT project, count(*) AS n, {S('v')} AS total, max(v) AS top FROM (SELECT project, resource, {S('actual_cost')} AS v
 FROM boq_resources GROUP BY 1,2) GROUP BY 1""", "boq_resources")
b.define("last_cash", "SELECT project, arg_max(cash_in_cum,month) AS cin, arg_max(cash_out_cum,month) AS cout FROM cashflow GROUP BY 1", "cashflow")
b.define("chosen", """SELECT * FROM methods QUALIFY row_number() OVER (PARTITION BY project ORDER BY
 CASE WHEN lower(method) LIKE '%revenue%' THEN 0 ELSE 1 END, idx)=1""", "methods")
BATCH_SQL = f"""
SELECT name AS project, 'cost_performance' AS control, CASE WHEN ev IS NULL OR ac IS NULL OR (ev=0 AND ac=0) THEN 'unavailable' ELSE {COST_RULE} END AS status
 FROM (SELECT *, CASE WHEN ac<>0 THEN ev/ac END AS cpi, ev-ac AS cv FROM (SELECT name, coalesce(k_ev_dashboard_scope,m_earned_value) AS ev,
 coalesce(k_actual_cost_dashboard_scope,m_actual_cost) AS ac FROM model))
UNION ALL SELECT project, 'profitability', {PROFIT_RULE.replace('margin', 'profit_pct').replace('TARGET', '0')} FROM chosen
UNION ALL SELECT project, 'cashflow', CASE WHEN cin IS NULL OR cout IS NULL OR (cin=0 AND cout=0) THEN 'unavailable'
 WHEN (CASE WHEN cin-cout<0 AND cin<>0 THEN abs(cin-cout)/abs(cin)*100 ELSE 0 END)>=15 THEN 'critical' WHEN cin-cout<0 THEN 'caution' ELSE 'favorable' END FROM last_cash
UNION ALL SELECT project, 'concentration', CASE WHEN total IS NULL OR total=0 THEN 'unavailable' WHEN abs(top)/abs(total)*100>40 THEN 'critical'
 WHEN abs(top)/abs(total)*100>25 THEN 'caution' ELSE 'favorable' END FROM raw_conc
UNION ALL SELECT project, 'data_quality', CASE WHEN severe>0 THEN 'critical' WHEN warnings>0 THEN 'caution' ELSE 'favorable' END FROM quality_counts"""


def batch_reading(model, methods, flow, boq, qcounts):
    """Five-rule batch reading; here concentration keeps negative amounts and a deficit
    without any cash-in counts as 0 %, unlike the main rules."""
    from ledgerloom.operators.portfolio import revenue_method
    ev = F.coalesce("k_ev_dashboard_scope", "m_earned_value")
    ac = F.coalesce("k_actual_cost_dashboard_scope", "m_actual_cost")
    cost = model.select(C("name").alias("project"), F.lit("cost_performance").alias("control"),
                        F.when(ev.isNull() | ac.isNull(), "unavailable").otherwise(
                            op.cost_performance(ev, ac, ratio(ev, ac), ev - ac)).alias("status"))
    profit = revenue_method(methods).select("project", F.lit("profitability").alias("control"),
                                            op.profitability(C("profit"), C("profit_pct")).alias("status"))
    last = flow.groupBy("project").agg(F.max_by(F.struct("cash_in_cum", "cash_out_cum"), "month").alias("l"))
    cin, cout = C("l.cash_in_cum"), C("l.cash_out_cum")
    deficit = F.when((cin - cout < 0) & (cin != 0), F.abs(cin - cout) / F.abs(cin) * 100).otherwise(F.lit(0.0))
    cash = last.select("project", F.lit("cashflow").alias("control"), op._graded(
        cin.isNull() | cout.isNull() | ((cin == 0) & (cout == 0)), deficit >= P["cash_deficit_critical_pct"], cin - cout < 0).alias("status"))
    g = boq.groupBy("project", "resource").agg(total_sum("actual_cost").alias("v")).groupBy("project").agg(
        total_sum("v").alias("total"), F.max("v").alias("top"))
    share = F.when(C("total") != 0, F.abs("top") / F.abs("total") * 100)
    conc = g.select("project", F.lit("concentration").alias("control"), op._graded(
        share.isNull(), share > P["concentration_critical_pct"], share > P["concentration_caution_pct"]).alias("status"))
    dq = qcounts.select("project", F.lit("data_quality").alias("control"),
                        op.data_quality(C("severe"), C("warnings"), F.lit(0)).alias("status"))
    return cost.unionByName(profit).unionByName(cash).unionByName(conc).unionByName(dq)


@query("r29_batch_reading", sql_with(BATCH_SQL, "chosen", "last_cash", "raw_conc", "quality_counts"))
def r29(spark, sf):
    lines = b.cost_cube(spark, sf, time="month raw_di", resource="main_code resource raw_di")
    m = b.project_model(spark, sf, lines["time"])
    return batch_reading(m, b.profit_methods(m), b.cashflow(spark, sf, lines["time"]), b.boq_resources(spark, sf, lines["resource"]), quality_counts(spark, sf, m))


b.define("vac_sums", f"""SELECT project, {S('coalesce(bac,0)')} AS bac, {S('coalesce(vac,0)')} AS vac FROM items WHERE bac IS NOT NULL GROUP BY 1""", "items")
LIVE_SQL = f"""
SELECT name AS project, 'cost_performance' AS control, CASE WHEN cpi<0.95 THEN 'critical' WHEN cpi<1 OR cv<0 THEN 'caution' ELSE 'favorable' END AS status
 FROM (SELECT name, m_earned_value/m_actual_cost AS cpi, m_earned_value-m_actual_cost AS cv FROM model)
UNION ALL SELECT project, 'forecast', CASE WHEN bac=0 OR bac IS NULL THEN 'unavailable' WHEN vac/abs(bac)*100<-5 THEN 'critical' WHEN vac/abs(bac)*100<0 THEN 'caution' ELSE 'favorable' END FROM vac_sums
UNION ALL SELECT project, 'profitability', CASE WHEN profit IS NULL THEN 'unavailable' WHEN profit<0 OR profit_pct<0 THEN 'critical' WHEN profit_pct IS NULL THEN 'caution' ELSE 'favorable' END FROM chosen
UNION ALL SELECT project, 'cashflow', CASE WHEN cin IS NULL OR cout IS NULL THEN 'unavailable' WHEN (CASE WHEN cin-cout<0 THEN CASE WHEN cin<>0 THEN abs(cin-cout)/abs(cin)*100 ELSE 100 END ELSE 0 END)>=15 THEN 'critical' WHEN cin-cout<0 THEN 'caution' ELSE 'favorable' END FROM last_cash
UNION ALL SELECT name, 'reconciliation', CASE WHEN reported IS NULL OR accounting IS NULL OR reported=0 THEN 'unavailable' WHEN abs(accounting-reported)/abs(reported)*100>5 THEN 'critical'
 WHEN abs(accounting-reported)/abs(reported)*100>1 THEN 'caution' ELSE 'favorable' END FROM (SELECT name, k_ledger_accounting_cost AS accounting, coalesce(k_actual_cost_dashboard_scope,m_actual_cost) AS reported FROM model)
UNION ALL SELECT name, 'indirect', {IND_RULE} FROM (SELECT name, k_indirect_budget_cost AS budget, coalesce(k_indirect_actual,m_indirect_cost) AS actual,
 k_indirect_budget_cost-coalesce(k_indirect_actual,m_indirect_cost) AS variance FROM model)
UNION ALL SELECT project, 'concentration', CASE WHEN max(actual_cost)/{S('actual_cost')}*100>40 THEN 'critical' WHEN max(actual_cost)/{S('actual_cost')}*100>25 THEN 'caution' ELSE 'favorable' END
 FROM boq_resources WHERE actual_cost>0 GROUP BY project
UNION ALL SELECT project, 'data_quality', CASE WHEN severe>0 THEN 'critical' WHEN warnings>0 OR findings>0 THEN 'caution' ELSE 'favorable' END FROM quality_counts"""


@query("r30_eight_controls", sql_with(LIVE_SQL, "vac_sums", "chosen", "last_cash", "boq_resources", "quality_counts"))
def r30(spark, sf):
    from ledgerloom.operators.portfolio import revenue_method
    lines = b.cost_cube(spark, sf, time="month raw_di", package="main_code division raw_di", resource="main_code resource raw_di")
    m = b.project_model(spark, sf, lines["time"])
    ev, ac = C("m_earned_value"), C("m_actual_cost")
    cpi = ratio(ev, ac)

    def out(df, control, status, key="project"):
        return df.select(C(key).alias("project"), F.lit(control).alias("control"), status.alias("status"))

    g = op._graded
    items = nz.project_items(b.direct_details(spark, sf, lines["package"])).filter("bac IS NOT NULL").groupBy("project").agg(
        total_sum("bac").alias("bac"), total_sum(F.coalesce("vac", F.lit(0.0))).alias("vac"))
    vac = F.when(C("bac") != 0, C("vac") / F.abs("bac") * 100)
    meth = revenue_method(b.profit_methods(m))
    last = b.cashflow(spark, sf, lines["time"]).groupBy("project").agg(F.max_by(F.struct("cash_in_cum", "cash_out_cum"), "month").alias("l"))
    cin, cout = C("l.cash_in_cum"), C("l.cash_out_cum")
    net = cin - cout
    deficit = F.when(net < 0, F.when(cin != 0, F.abs(net) / F.abs(cin) * 100).otherwise(F.lit(100.0))).otherwise(F.lit(0.0))
    acc, rep = C("k_ledger_accounting_cost"), F.coalesce("k_actual_cost_dashboard_scope", "m_actual_cost")
    gap = F.when(rep != 0, F.abs(acc - rep) / F.abs(rep) * 100)
    ib, ia = C("k_indirect_budget_cost"), F.coalesce("k_indirect_actual", "m_indirect_cost")
    boq = b.boq_resources(spark, sf, lines["resource"]).filter("actual_cost > 0").groupBy("project").agg(
        F.max("actual_cost").alias("top"), total_sum("actual_cost").alias("total"))
    share = C("top") / C("total") * 100
    q = quality_counts(spark, sf, m)
    parts = [
        out(m, "cost_performance", g(cpi.isNull(), cpi < P["cpi_caution"], (cpi < 1) | (ev - ac < 0)), "name"),
        out(items, "forecast", g(vac.isNull(), vac < P["vac_caution_pct"], vac < 0)),
        out(meth, "profitability", g(C("profit").isNull(), (C("profit") < 0) | (C("profit_pct") < 0), C("profit_pct").isNull())),
        out(last, "cashflow", g(cin.isNull() | cout.isNull(), deficit >= P["cash_deficit_critical_pct"], net < 0)),
        out(m, "reconciliation", g(gap.isNull(), gap > P["reconciliation_critical_pct"], gap > P["reconciliation_caution_pct"]), "name"),
        out(m, "indirect", op.indirect_variance(ib, ia, ib - ia), "name"),
        out(boq, "concentration", g(share.isNull(), share > P["concentration_critical_pct"], share > P["concentration_caution_pct"])),
        out(q, "data_quality", g(F.lit(False), C("severe") > 0, (C("warnings") > 0) | (C("findings") > 0))),
    ]
    df = parts[0]
    for x in parts[1:]:
        df = df.unionByName(x)
    return df
