"""Registered period, ranking and control queries."""

from pyspark.sql import functions as F

from ledgerloom.functions import line_sum, ratio, total_sum
from ledgerloom.operators import extended as op
from ledgerloom.plans import bindings as b
from ledgerloom.plans.bindings import RUN, S, sql_with
from ledgerloom.plans.portfolio_queries import quality
from ledgerloom.plans.registry import query

C = F.col


def _snap_sql(keys, source):
    part = ", ".join(keys)
    return f"""SELECT *, CASE WHEN ac<>0 THEN ev/ac END AS cpi, ev-ac AS cv, bac-ev AS etc, ac+(bac-ev) AS eac, bac-(ac+(bac-ev)) AS vac FROM
 (SELECT {part}, month, {RUN('bac', part)} AS bac, {RUN('ev', part)} AS ev, {RUN('ac', part)} AS ac FROM {source})"""


b.define("snap", _snap_sql(["project"], "project_months"), "project_months")
b.define("wsnap", _snap_sql(["project", "main_code"], "work_packages"), "work_packages")


def snap(spark, sf, lines=None):
    return op.snapshots(b.project_months(spark, sf, lines), ["project"])


def wsnap(spark, sf):
    return op.snapshots(b.work_packages(spark, sf), ["project", "main_code"])


def cum_cash(spark, sf, lines=None):
    return b.cashflow(spark, sf, lines).select("project", "month", "cash_in_cum", "cash_out_cum")


@query("x01_rag_status", sql_with("""
SELECT project, month, CASE WHEN cpi IS NULL THEN NULL WHEN cpi>=1 THEN 'green' WHEN cpi>=0.95 THEN 'amber' ELSE 'red' END AS cpi_status,
 CASE WHEN ev=0 THEN NULL WHEN cv>=0 THEN 'green' WHEN cv/abs(ev)*100>=-5 THEN 'amber' ELSE 'red' END AS cv_status,
 CASE WHEN bac=0 THEN NULL WHEN eac<=bac THEN 'green' WHEN eac/bac<=1.05::DOUBLE THEN 'amber' ELSE 'red' END AS forecast_status,
 CASE WHEN net IS NULL THEN NULL WHEN net>0 AND (pnet IS NULL OR net>=pnet) THEN 'green' WHEN net>0 THEN 'amber' ELSE 'red' END AS cash_status,
 CASE WHEN pcpi IS NULL OR cpi IS NULL THEN NULL WHEN cpi>pcpi THEN 'up' WHEN cpi<pcpi THEN 'down' ELSE 'flat' END AS movement
FROM (SELECT *, lag(net) OVER w AS pnet, lag(cpi) OVER w AS pcpi FROM (SELECT s.*, cash_in_cum-cash_out_cum AS net FROM snap s
 LEFT JOIN cashflow c ON c.project=s.project AND c.month=s.month) WINDOW w AS (PARTITION BY project ORDER BY month))""", "snap", "cashflow"))
def x01(spark, sf):
    return op.rag(snap(spark, sf), cum_cash(spark, sf))


DELTA_METRICS = ["ev", "ac", "cv", "cpi", "eac"]
BETTER = ["ev", "cv", "cpi"]
b.define("snap_long", " UNION ALL ".join(f"SELECT project, month, '{m}' AS metric, {m} AS value FROM snap" for m in DELTA_METRICS), "snap")
b.define("delta", """SELECT project, month, metric, value, prior, value-prior AS delta, CASE WHEN prior<>0 THEN (value-prior)/abs(prior)*100 END AS delta_pct,
 CASE WHEN value-prior=0 THEN 'same' WHEN (metric IN ('ev','cv','cpi') AND value-prior>0) OR (metric NOT IN ('ev','cv','cpi') AND value-prior<0) THEN 'better' ELSE 'worse' END AS direction
 FROM (SELECT *, lag(value) OVER (PARTITION BY project, metric ORDER BY month) AS prior FROM snap_long) WHERE prior IS NOT NULL""", "snap_long")


def delta(spark, sf):
    return op.month_delta(snap(spark, sf), DELTA_METRICS, BETTER)


@query("x02_month_delta", sql_with("SELECT * FROM delta", "delta"))
def x02(spark, sf):
    return delta(spark, sf)


@query("x03_monthly_growth", sql_with("SELECT project, month, 'increment' AS basis, " + ", ".join(
    f"{c}-coalesce(lag({c}) OVER (PARTITION BY project ORDER BY month),0) AS {c}_growth" for c in ("ac", "ev", "cv", "eac"))
    + " FROM snap UNION ALL SELECT project, month, 'cumulative', ac, ev, cv, eac FROM snap", "snap"))
def x03(spark, sf):
    s = snap(spark, sf)
    return op.growth(s, False).withColumn("basis", F.lit("increment")).unionByName(
        op.growth(s, True).withColumn("basis", F.lit("cumulative")))


CMP = ["cpi", "cv", "vac", "ev"]
b.define("last_snap", "SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY project ORDER BY month DESC)=1", "snap")


@query("x04_comparison_matrix", sql_with(f"""
SELECT metric, best, best_value, worst, worst_value, benchmark, best_value-worst_value AS max_delta FROM (SELECT metric, first(project ORDER BY value DESC, project) AS best,
 max(value) AS best_value, first(project ORDER BY value, project) AS worst, min(value) AS worst_value, {S('value')}/count(value) AS benchmark FROM ("""
    + " UNION ALL ".join(f"SELECT project, '{m}' AS metric, {m} AS value FROM last_snap" for m in CMP) + ") GROUP BY metric)", "last_snap"))
def x04(spark, sf):
    return op.comparison(op.latest(snap(spark, sf)), CMP)


@query("x05_project_ranking", sql_with("""
SELECT *, rank() OVER (ORDER BY composite, project) AS overall_rank FROM (SELECT *, round(efficiency_rank*0.5::DOUBLE+variance_rank*0.3::DOUBLE+forecast_rank*0.2::DOUBLE,6) AS composite FROM
 (SELECT project, month, cpi, cv, eac, vac, cv/ev*100 AS cv_pct, vac/bac*100 AS vac_pct, rank() OVER (ORDER BY cpi DESC) AS efficiency_rank,
  rank() OVER (ORDER BY cv/ev*100 DESC) AS variance_rank, rank() OVER (ORDER BY vac/bac*100 DESC) AS forecast_rank FROM last_snap))""", "last_snap"))
def x05(spark, sf):
    return op.ranking(op.latest(snap(spark, sf)))


@query("x06_variance_heat_map", sql_with(f"SELECT main_code, month, {S('ev-ac')} AS cv FROM work_packages GROUP BY 1,2", "work_packages"))
def x06(spark, sf):
    g = b.cost_lines(spark, sf, part=True).groupBy("main_code", "month").agg(*b.money_sums("ev", "ac"))
    return g.select("main_code", "month", F.round(C("ev") - C("ac"), 6).alias("cv"))


@query("x07_deterioration_streak", sql_with("""
SELECT project, main_code, len AS longest, until FROM (SELECT project, main_code, island, count(*) AS len, max(month) AS until FROM
 (SELECT *, sum(CASE WHEN down THEN 0 ELSE 1 END) OVER (PARTITION BY project, main_code ORDER BY month) AS island FROM
  (SELECT project, main_code, month, cpi < lag(cpi) OVER (PARTITION BY project, main_code ORDER BY month) AS down FROM wsnap)) WHERE down GROUP BY 1,2,3)
QUALIFY row_number() OVER (PARTITION BY project, main_code ORDER BY len DESC, until DESC)=1""", "wsnap"))
def x07(spark, sf):
    return op.deterioration(wsnap(spark, sf), ["project", "main_code"], "cpi")


EXC_CTE = """SELECT *, lag(cpi) OVER w AS p1, lag(cpi,2) OVER w AS p2, lag(cpi,3) OVER w AS p3, lag(eac) OVER w AS peac, lag(ac) OVER w AS pac, lag(ev) OVER w AS pev,
 lag(net) OVER w AS pnet FROM (SELECT s.*, cash_in_cum-cash_out_cum AS net FROM snap s LEFT JOIN cashflow c ON c.project=s.project AND c.month=s.month)
 WINDOW w AS (PARTITION BY project ORDER BY month)"""
b.define("exc", EXC_CTE, "snap", "cashflow")
EXC_RULES = [("cpi_below_threshold", 3, "cpi<0.95"), ("cpi_deteriorated", 2, "p1-cpi>0.01"), ("cv_materially_negative", 3, "cv/abs(ev)*100<-5"),
             ("eac_increased", 2, "(eac-peac)/peac*100>2"), ("vac_negative", 2, "vac<0"), ("ac_outgrows_ev", 2, "(ac-pac)/pac-(ev-pev)/pev>0.001"),
             ("cash_turned_negative", 3, "net<0 AND pnet>=0"), ("three_months_deterioration", 3, "cpi<p1 AND p1<p2 AND p2<p3")]
PKG_RULES = [("package_cpi_below_threshold", 2, "ev/ac<0.93"), ("code_over_budget", 2, "ac>bac*1.05::DOUBLE"), ("category_variance", 1, "(ev-ac)/ev*100<-7")]


@query("x08_management_exceptions", sql_with(
    "SELECT project, rule, severity, count(*) AS occurrences, min(month) AS first_month, max(month) AS last_month FROM ("
    + " UNION ALL ".join([f"SELECT project, month, '{n}' AS rule, {s} AS severity FROM exc WHERE {c}" for n, s, c in EXC_RULES]
                         + [f"SELECT project, month, '{n}', {s} FROM work_packages WHERE {c}" for n, s, c in PKG_RULES])
    + ") GROUP BY 1,2,3", "exc", "work_packages"))
def x08(spark, sf):
    lines = b.cost_cube(spark, sf, ("bac", "ev", "ac"), coded=False, month="month", package="main_code month")
    return op.exceptions(snap(spark, sf, lines["month"]), cum_cash(spark, sf, lines["month"]), b.work_packages(spark, sf, lines["package"]))


@query("x09_month_basis", sql_with("""
SELECT 'common' AS basis, project, month, ev, ac, cpi FROM snap WHERE month=(SELECT max(month) FROM (SELECT month FROM snap GROUP BY month
 HAVING count(DISTINCT project)=(SELECT count(DISTINCT project) FROM snap)))
UNION ALL SELECT 'latest', project, month, ev, ac, cpi FROM last_snap UNION ALL SELECT 'selected', project, month, ev, ac, cpi FROM snap WHERE month=(SELECT min(month) FROM snap)""", "last_snap"))
def x09(spark, sf):
    return op.month_basis(snap(spark, sf, b.cost_cube(spark, sf, ("bac", "ev", "ac"), month="month")["month"]))


def cost_cube(spark, sf):
    """Pre-aggregated leaf table of the roll-ups: hierarchies never expand raw lines."""
    return b.cost_lines(spark, sf, part=True, supplier=True).groupBy(
        "project", "raw_di", "division", "main_code", "resource", "month").agg(line_sum("ac").alias("ac"), F.count("*").alias("n"))


@query("x10_category_tables", sql_with(f"""
SELECT c.project, c.raw_di, division, ac, CASE WHEN group_ac<>0 THEN ac/group_ac END*100 AS pct_of_group, CASE WHEN total_ac<>0 THEN ac/total_ac END*100 AS pct_of_total FROM
 (SELECT project, raw_di, division, {S('ac')} AS ac FROM cost_lines GROUP BY 1,2,3) c JOIN (SELECT project, raw_di, {S('ac')} AS group_ac FROM cost_lines GROUP BY 1,2) g
 ON g.project=c.project AND g.raw_di=c.raw_di JOIN (SELECT project, {S('ac')} AS total_ac FROM cost_lines GROUP BY 1) t ON t.project=c.project""", "cost_lines"))
def x10(spark, sf):
    leaf = b.cost_lines(spark, sf, part=True).groupBy("project", "raw_di", "division").agg(line_sum("ac").alias("ac"))
    return op.share_table(leaf)


@query("x11_resource_variance", sql_with(f"""
SELECT project, main_code, resource, bq-q AS qty_variance, bc/bq-ac/q AS rate_variance, bc-ac AS cost_variance, (bc/bq-ac/q)*q AS price_effect, (bq-q)*(bc/bq) AS usage_effect
FROM (SELECT project, main_code, resource, {S('work_qty')} AS q, {S('work_qty')}*1.1::DOUBLE AS bq, {S('ac')} AS ac, {S('bac')} AS bc FROM cost_lines GROUP BY 1,2,3)""", "cost_lines"))
def x11(spark, sf):
    res = b.cost_lines(spark, sf, part=True, supplier=True).groupBy("project", "main_code", "resource").agg(
        line_sum("work_qty").alias("work_qty"), line_sum("ac").alias("actual_cost"), line_sum("bac").alias("budget_cost"))
    return op.resource_variance(res.withColumn("budget_qty", C("work_qty") * 1.1))


@query("x12_drill_tree", sql_with(f"""
SELECT project, division, main_code, resource, {S('ac')} AS ac, count(*) AS transactions, CAST(grouping_id(project,division,main_code,resource) AS BIGINT) AS level
FROM cost_lines GROUP BY ROLLUP(project, division, main_code, resource)""", "cost_lines"))
def x12(spark, sf):
    return op.drill_tree(cost_cube(spark, sf))


@query("x13_ledger_groups", sql_with(f"""
SELECT CASE WHEN grouping(month)=0 THEN 'month' WHEN grouping(resource)=0 THEN 'resource' WHEN grouping(main_code)=0 THEN 'main_code' ELSE 'division' END AS grouping,
 coalesce(month,resource,main_code,division) AS name, {S('ac')} AS ac, count(*) AS transactions FROM cost_lines
WHERE ac BETWEEN 10000 AND 60000 AND month BETWEEN '1993-04' AND '1997-09' GROUP BY GROUPING SETS ((month),(resource),(main_code),(division))""", "cost_lines"))
def x13(spark, sf):
    return op.ledger_groups(b.cost_lines(spark, sf, part=True, supplier=True), 10000.0, 60000.0, "1993-04", "1997-09")


CHECKS = {
    "direct_plus_indirect": ("bac_d+bac_i", "bac"), "ledger_vs_accounting": ("ac", "ledger"), "months_vs_ledger": ("month_ac", "ac"),
    "package_budget": ("pkg_bac", "bac"), "package_ev": ("pkg_ev", "ev"), "package_ac": ("pkg_ac", "ac"),
    "cash_months": ("cash_out", "ac"), "resource_vs_direct": ("res_ac", "direct_kpi"),
}
b.define("control_facts", f"""SELECT m.name AS project, m_budget AS bac, m_earned_value AS ev, m_actual_cost AS ac, k_ledger_accounting_cost AS ledger, k_direct_budget_cost AS bac_d,
 k_indirect_budget_cost AS bac_i, k_direct_actual AS direct_kpi, p.pkg_bac, p.pkg_ev, p.pkg_ac, mo.month_ac, ca.cash_out, re.res_ac FROM model m
 LEFT JOIN (SELECT project, {S('bac')} AS pkg_bac, {S('ev')} AS pkg_ev, {S('ac')} AS pkg_ac FROM work_packages GROUP BY 1) p ON p.project=m.name
 LEFT JOIN (SELECT project, {S('ac')} AS month_ac FROM project_months GROUP BY 1) mo ON mo.project=m.name
 LEFT JOIN (SELECT project, {S('cash_out')} AS cash_out FROM cash GROUP BY 1) ca ON ca.project=m.name
 LEFT JOIN (SELECT project, {S('actual_cost')} AS res_ac FROM boq_resources GROUP BY 1) re ON re.project=m.name""",
         "model", "work_packages", "project_months", "cash", "boq_resources")


@query("x14_control_totals", sql_with("""
SELECT project, check_name, left_total, right_total, CASE WHEN left_total IS NULL OR right_total IS NULL THEN 'Not Available'
 WHEN abs(left_total-right_total)<=abs(right_total)*(0.01::DOUBLE/100) THEN 'Reconciled' ELSE 'Warning' END AS status FROM control_facts, LATERAL (VALUES """
    + ",".join(f"('{n}',{l},{r})" for n, (l, r) in CHECKS.items()) + ") v(check_name,left_total,right_total)", "control_facts"))
def x14(spark, sf):
    lines = b.cost_cube(spark, sf, coded=False, time="month raw_di", package="main_code month", resource="main_code resource raw_di")
    m = b.project_model(spark, sf, lines["time"]).select(
        C("name").alias("project"), C("m_budget").alias("bac"), C("m_earned_value").alias("ev"), C("m_actual_cost").alias("ac"),
        C("k_ledger_accounting_cost").alias("ledger"), C("k_direct_budget_cost").alias("bac_d"), C("k_indirect_budget_cost").alias("bac_i"),
        C("k_direct_actual").alias("direct_kpi"))
    pkg = b.work_packages(spark, sf, lines["package"]).groupBy("project").agg(*[total_sum(c).alias(f"pkg_{c}") for c in ("bac", "ev", "ac")])
    mo = b.project_months(spark, sf, lines["time"]).groupBy("project").agg(total_sum("ac").alias("month_ac"))
    ca = b.cash(spark, sf, lines["time"]).groupBy("project").agg(total_sum("cash_out").alias("cash_out"))
    re = b.boq_resources(spark, sf, lines["resource"]).groupBy("project").agg(total_sum("actual_cost").alias("res_ac"))
    for part in (pkg, mo, ca, re):
        m = m.join(part, "project", "left")
    pairs = m.select("project", F.inline(F.array(*[
        F.struct(F.lit(n).alias("check_name"), F.expr(l).alias("left_total"), F.expr(r).alias("right_total")) for n, (l, r) in CHECKS.items()])))
    return op.control_totals(pairs)


@query("x15_forecast_bands", sql_with("""
SELECT project, main_code, month, eac-bac AS overrun, (eac-bac)/bac AS overrun_pct, CASE WHEN bac=0 THEN NULL WHEN eac/bac<=1.02::DOUBLE THEN 'Low' WHEN eac/bac<=1.05::DOUBLE THEN 'Medium'
 WHEN eac/bac<=1.10::DOUBLE THEN 'High' ELSE 'Critical' END AS band FROM wsnap""", "wsnap"))
def x15(spark, sf):
    return op.forecast_bands(wsnap(spark, sf))


@query("x16_cpi_bands", sql_with(f"""
SELECT project, main_code, month, CASE WHEN ev/ac>=1 THEN 'Healthy' WHEN ev/ac>=0.95 THEN 'Watch' WHEN ev/ac>=0.90 THEN 'High' ELSE 'Critical' END AS band,
 bac/q AS planned_unit_cost, ac/q AS actual_unit_cost, ac/q-bac/q AS unit_gap FROM (SELECT project, main_code, month, {S('bac')} AS bac, {S('ev')} AS ev, {S('ac')} AS ac, {S('work_qty')} AS q
 FROM cost_lines GROUP BY 1,2,3)""", "cost_lines"))
def x16(spark, sf):
    g = b.cost_lines(spark, sf, part=True).groupBy("project", "main_code", "month").agg(*b.money_sums("bac", "ev", "ac", "work_qty"))
    plan, act = ratio("bac", "work_qty"), ratio("ac", "work_qty")
    return g.select("project", "main_code", "month", op.cpi_band(ratio("ev", "ac")).alias("band"), plan.alias("planned_unit_cost"),
                    act.alias("actual_unit_cost"), (act - plan).alias("unit_gap"))


@query("x17_growth_signals", sql_with("""
SELECT project, month, CASE WHEN petc<>0 THEN (etc-petc)/petc END AS etc_growth, coalesce((CASE WHEN petc<>0 THEN (etc-petc)/petc END)>0.05,false) AS etc_deterioration,
 ac+0.1::DOUBLE*bac+etc>bac AS commitment_breach, CASE WHEN abs(cv)<>0 THEN 0.05::DOUBLE*bac/abs(cv) END AS contingency_coverage FROM
 (SELECT *, lag(etc) OVER (PARTITION BY project ORDER BY month) AS petc FROM snap)""", "snap"))
def x17(spark, sf):
    # Commitments are 10 % and contingency 5 % of the budget to date.
    prior = F.lag("etc").over(op.by_month("project"))
    g = snap(spark, sf).withColumn("etc_growth", F.when(prior != 0, (C("etc") - prior) / prior))
    return g.select(
        "project", "month", "etc_growth", F.coalesce(C("etc_growth") > 0.05, F.lit(False)).alias("etc_deterioration"),
        (C("ac") + C("bac") * 0.1 + C("etc") > C("bac")).alias("commitment_breach"),
        ratio(C("bac") * 0.05, F.abs("cv")).alias("contingency_coverage"))


@query("x18_revenue_leakage", sql_with("""
SELECT p.project, p.month, ev AS executed, coalesce(cash_in,0) AS certified, ev-coalesce(cash_in,0) AS uncertified, coalesce(cash_in,0)-coalesce(cash_in,0)*0.9::DOUBLE AS outstanding
FROM project_months p LEFT JOIN cash c ON c.project=p.project AND c.month=p.month""", "project_months", "cash"))
def x18(spark, sf):
    j = b.project_months(spark, sf).join(b.cash(spark, sf), ["project", "month"], "left")
    cert = F.coalesce("cash_in", F.lit(0.0))
    return j.select("project", "month", C("ev").alias("executed"), cert.alias("certified"), (C("ev") - cert).alias("uncertified"),
                    (cert - cert * 0.9).alias("outstanding"))


@query("x19_forecast_reliability", sql_with("""
SELECT project, main_code, count(*) AS periods, count(*) FILTER (eac>peac) AS rising_eac, count(*) FILTER (etc>petc) AS rising_etc,
 count(*) FILTER (eac<>peac) AS revisions, round(stddev_pop(eac/bac),6) AS volatility FROM (SELECT *, lag(eac) OVER w AS peac, lag(etc) OVER w AS petc FROM wsnap
 WINDOW w AS (PARTITION BY project, main_code ORDER BY month)) GROUP BY 1,2""", "wsnap"))
def x19(spark, sf):
    w = op.by_month("project", "main_code")
    d = wsnap(spark, sf).select("project", "main_code", "eac", "etc", "bac", F.lag("eac").over(w).alias("peac"), F.lag("etc").over(w).alias("petc"))
    return d.groupBy("project", "main_code").agg(
        F.count("*").alias("periods"), F.count_if(C("eac") > C("peac")).alias("rising_eac"), F.count_if(C("etc") > C("petc")).alias("rising_etc"),
        F.count_if(C("eac") != C("peac")).alias("revisions"), F.round(F.stddev_pop(C("eac") / C("bac")), 6).alias("volatility"))


RISK_PARTS = {
    "forecast": "least(100,greatest(0,(eac/bac-1)*1000))", "cpi": "least(100,greatest(0,(1-cpi)*1000))", "etc_growth": "least(100,greatest(0,etc/bac*100))",
    "commitment": "CASE WHEN ac>bac THEN 100 ELSE 0 END", "contingency": "CASE WHEN vac<0 THEN 60 ELSE 10 END", "cash": "CASE WHEN cv<0 THEN 50 ELSE 0 END",
    "revenue": "CASE WHEN ev<bac THEN 40 ELSE 0 END", "productivity": "CASE WHEN cpi<0.9 THEN 80 ELSE 20 END", "data_quality": "10",
}


@query("x20_weighted_risk_score", sql_with(f"""
SELECT project, main_code, month, score, CASE WHEN score<25 THEN 'Low' WHEN score<50 THEN 'Moderate' WHEN score<70 THEN 'High' WHEN score<85 THEN 'Very High' ELSE 'Critical' END AS risk_class,
 round(p*i,6) AS risk, round(p*i*1.2::DOUBLE,6) AS urgent_risk, round(p*abs(cv),4) AS emv FROM (SELECT *, least(1,greatest(0,1-cpi)*5)::DOUBLE AS p, least(5,abs(cv)/bac*100)::DOUBLE AS i, round({'+'.join(
    f'CAST({e} AS DOUBLE)*{op.RISK_WEIGHTS[n]}::DOUBLE' for n, e in RISK_PARTS.items())},6) AS score FROM wsnap)""", "wsnap"))
def x20(spark, sf):
    parts = wsnap(spark, sf).select(
        "project", "main_code", "month", *[F.expr(f"CAST({e} AS DOUBLE)").alias(f"r_{n}") for n, e in RISK_PARTS.items()],
        F.expr("CAST(least(1D, greatest(0D, 1 - cpi) * 5) AS DOUBLE)").alias("probability"),
        F.expr("CAST(least(5D, abs(cv) / bac * 100) AS DOUBLE)").alias("impact"), F.lit(1.2).alias("urgency"), F.abs("cv").alias("exposure"))
    return op.risk_score(parts.withColumnsRenamed({f"r_{n}": n for n in RISK_PARTS}))


@query("x21_transaction_quality", """
SELECT 'duplicate_transactions' AS finding, CAST(coalesce(sum(k-1),0) AS BIGINT) AS rows FROM (SELECT count(*) AS k FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>1)
UNION ALL SELECT 'unmapped_code', count(*) FROM lineitem ANTI JOIN part ON l_partkey=p_partkey UNION ALL SELECT 'missing_code', count(*) FROM lineitem WHERE l_partkey IS NULL
UNION ALL SELECT 'negative_value', count(*) FROM lineitem WHERE l_extendedprice<0 UNION ALL SELECT 'zero_quantity', count(*) FROM lineitem WHERE l_quantity<=0
UNION ALL SELECT 'zero_tax', count(*) FROM lineitem WHERE l_tax=0 UNION ALL SELECT 'bad_period', count(*) FROM lineitem WHERE l_shipdate IS NULL OR year(l_shipdate)<1990""")
def x21(spark, sf):
    return op.transaction_findings(b.table(spark, sf, "lineitem"), b.table(spark, sf, "part").select("p_partkey"))


b.define("exposure", f"""SELECT project, division AS driver, {S('CASE WHEN ac>ev THEN ac-ev ELSE 0 END')} AS exposure FROM cost_lines GROUP BY 1,2""", "cost_lines")


def exposure(spark, sf):
    return b.cost_lines(spark, sf, part=True).groupBy("project", C("division").alias("driver")).agg(
        line_sum(F.when(C("ac") > C("ev"), C("ac") - C("ev")).otherwise(F.lit(0.0))).alias("exposure"))


@query("x22_driver_shares", sql_with("""
SELECT project, driver, exposure, exposure/CAST(sum(CAST(exposure AS DECIMAL(38,6))) OVER (PARTITION BY project) AS DOUBLE)*100 AS share_pct FROM exposure""", "exposure"))
def x22(spark, sf):
    return op.driver_shares(exposure(spark, sf))


@query("x23_residual_risk", sql_with("""
SELECT project, driver, exposure AS current_exposure, exposure*0.35::DOUBLE+1000 AS reduction, greatest(0,exposure-(exposure*0.35::DOUBLE+1000)) AS residual FROM exposure""", "exposure"))
def x23(spark, sf):
    red = C("exposure") * 0.35 + 1000
    return exposure(spark, sf).select("project", "driver", C("exposure").alias("current_exposure"), red.alias("reduction"),
                                      F.greatest(F.lit(0.0), C("exposure") - red).alias("residual"))


@query("x24_action_register", sql_with("""
SELECT project, orderkey, linenumber, severity AS priority, CASE WHEN k>3 THEN 'open' ELSE 'planned' END AS status, project||'-owner' AS owner FROM quality
WHERE severity IN ('critical','warning')""", "quality"))
def x24(spark, sf):
    q = quality(spark, sf)
    actions = q.select("project", "orderkey", "linenumber", C("severity").alias("priority"),
                       F.when(C("k") > 3, "open").otherwise("planned").alias("status"), F.concat(C("project"), F.lit("-owner")).alias("owner"))
    return actions.filter(C("priority").isin("critical", "warning"))


@query("x25_risk_trend", sql_with("""
SELECT project, month, score, CASE WHEN d IS NULL THEN NULL WHEN d>0.001 THEN 'deteriorating' WHEN d<-0.001 THEN 'improving' ELSE 'stable' END AS tag FROM
 (SELECT *, score-lag(score) OVER (PARTITION BY project ORDER BY month) AS d FROM (SELECT project, month, eac/bac AS score FROM snap))""", "snap"))
def x25(spark, sf):
    s = snap(spark, sf).select("project", "month", (C("eac") / C("bac")).alias("score"))
    return op.trend_tag(s, 0.001)


@query("x26_commentary_facts", sql_with("""
SELECT month, 'Largest CPI deterioration: '||first(project ORDER BY delta, project) AS deterioration, min(delta) AS deterioration_delta,
 'Largest CPI improvement: '||first(project ORDER BY delta DESC, project) AS improvement, max(delta) AS improvement_delta FROM delta WHERE metric='cpi' GROUP BY month""", "delta"))
def x26(spark, sf):
    return op.commentary(delta(spark, sf))
