"""Registered normalisation queries over typed rows."""

from pyspark.sql import functions as F

from ledgerloom.functions import line_sum
from ledgerloom.operators import extract as ex
from ledgerloom.operators import normalize as nz
from ledgerloom.plans import bindings as b
from ledgerloom.plans import workbook as wb
from ledgerloom.plans.bindings import RUN, S, sql_with
from ledgerloom.plans.project_queries import items
from ledgerloom.plans.registry import query

ITEM_COLS = ("project,main_code,division,item,original_budget,ev,ac,cv,status_to_date,cpi_to_date,completion,bac,eac,etc,vac,"
             "forecast_status,cpi_forecast")


@query("n02_project_items", sql_with(f"SELECT {ITEM_COLS} FROM items", "items"))
def n02(spark, sf):
    return items(spark, sf)


b.define("direct_codes", f"""SELECT project, main_code FROM (SELECT project, main_code,
 {S("CASE WHEN raw_di='D' THEN bac END")} AS d, {S("CASE WHEN raw_di='I' THEN bac END")} AS i FROM ledger_lines GROUP BY 1,2)
 WHERE d>=coalesce(i,0)""", "ledger_lines")


def direct_codes(lines):
    """Verified direct codes of a project: codes whose direct budget is at least the indirect one."""
    return lines.groupBy("project", "main_code").agg(
        line_sum(F.when(F.col("raw_di") == "D", F.col("bac"))).alias("d"),
        line_sum(F.when(F.col("raw_di") == "I", F.col("bac"))).alias("i"),
    ).filter("d >= coalesce(i, 0D)").select("project", "main_code")


b.define("classified", """SELECT l.*, CASE WHEN c.main_code IS NOT NULL OR di0='D' THEN 'D' ELSE 'I' END AS di2 FROM
 (SELECT *, di AS di0 FROM ledger) l LEFT JOIN direct_codes c ON c.project=l.project AND c.main_code=l.main_code""",
         "ledger", "direct_codes")


def classified(spark, sf):
    lines = b.cost_cube(spark, sf, ("bac", "ac", "work_qty"), entry="main_code resource source raw_di", code="main_code raw_di")
    return nz.classify(b.ledger_totals(spark, sf, lines["entry"]).withColumnRenamed("di", "raw_di"), direct_codes(lines["code"]))


@query("n07_direct_indirect", sql_with("""
SELECT project, main_code, resource, source, di AS raw_di, di2 AS di, total_cost FROM classified""", "classified"))
def n07(spark, sf):
    return classified(spark, sf).select("project", "main_code", "resource", "source", "raw_di", "di", "total_cost")


@query("n08_ledger_aggregates", sql_with(f"""
SELECT project, 'code' AS grouping, main_code AS name, {S('total_cost')} AS value FROM classified GROUP BY 1,3
UNION ALL SELECT project, 'source', source, {S('total_cost')} FROM classified GROUP BY 1,3
UNION ALL SELECT project, 'class', di2, {S('total_cost')} FROM classified GROUP BY 1,3
UNION ALL SELECT project, 'accounting', 'all', {S('total_cost')} FROM classified GROUP BY 1
UNION ALL SELECT p.project, 'month', m.month, coalesce(t.total,0) FROM (SELECT DISTINCT project FROM ledger) p CROSS JOIN
 (SELECT DISTINCT month FROM ledger_months_detail WHERE abs(total)>0) m LEFT JOIN
 (SELECT project, month, {S('total')} AS total FROM ledger_months_detail GROUP BY 1,2) t ON t.project=p.project AND t.month=m.month""",
                                       "classified", "ledger_months_detail"))
def n08(spark, sf):
    lines = b.cost_cube(spark, sf, ("bac", "ac"), entry="main_code source raw_di", month="month")
    months = nz.ledger_by_month(lines["month"].select("project", "month", F.col("ac").alias("total"))).select(
        "project", F.lit("month").alias("grouping"), F.col("month").alias("name"), F.col("total").alias("value"))
    entries = nz.classify(lines["entry"].withColumnRenamed("ac", "total_cost"), direct_codes(lines["entry"]))
    return nz.ledger_rollups(entries).unionByName(months)


_SHORT = "length({}) % 2 = 0"
b.define("realloc_sheet", f"SELECT project, main_code, coalesce(other_cost, 0) AS other_cost, CASE WHEN {_SHORT.format('project')} THEN NULL ELSE coalesce(equipment, 0) END AS equipment FROM realloc", "realloc")


@query("n11_reallocation", sql_with("""
SELECT a.project AS file, a.main_code, 'Works of '||a.main_code AS item, a.resource, actual_cost,
 CASE WHEN a.resource=f.first THEN coalesce(other_cost,0) ELSE 0 END AS other_cost_realloc,
 CASE WHEN a.resource=f.first THEN coalesce(equipment,0) ELSE 0 END AS equipment_realloc FROM boq_resources a
JOIN (SELECT project, main_code, min(resource) AS first FROM boq_resources GROUP BY 1,2) f ON f.project=a.project AND f.main_code=a.main_code
LEFT JOIN realloc_sheet r ON r.project=a.project AND r.main_code=a.main_code""", "boq_resources", "realloc_sheet"))
def n11(spark, sf):
    return ex.reallocated_allocation(wb.workbook_cells(spark, sf, "breakdown", "reallocation")).drop("row")


@query("n11_reallocation_totals", sql_with(f"""SELECT project, coalesce({S('other_cost')},0) AS other_cost_total,
 coalesce({S('equipment')},0) AS equipment_total, count(DISTINCT main_code) AS codes FROM realloc_sheet GROUP BY 1""", "realloc_sheet"))
def n11_totals(spark, sf):
    amounts = ex.reallocation(wb.workbook_cells(spark, sf, "breakdown", "reallocation"))
    return nz.reallocation_totals(amounts.withColumnRenamed("file", "project"))


_WASTE_FIELDS = f"""SELECT n_name AS project, CASE p_type WHEN 'STANDARD' THEN 2 ELSE 4 END + CASE WHEN l_discount>0.05::DOUBLE THEN 1 ELSE 0 END AS c, {S('l_quantity')} AS actual, {S('l_quantity*(1-l_discount)')} AS eng
 FROM lineitem JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2"""


@query("n13_waste_detail", f"""SELECT project AS file, c::BIGINT AS col, CASE WHEN c<4 THEN 'Steel' ELSE 'Concrete' END AS type, 'Item '||c AS item, CASE WHEN c<4 THEN 't' ELSE 'm3' END AS unit, actual, e AS engineering,
 floor(actual/10) AS stock, eng-1 AS owner_qty, CASE WHEN {_SHORT.format('project')} THEN actual-e ELSE actual-eng+0.5 END AS waste_qty,
 CASE WHEN {_SHORT.format('project')} THEN (actual-e)/e ELSE (actual-eng)/eng+0.01 END AS waste_pct, 0.04::DOUBLE AS budget_waste_pct, (actual-eng)/eng-0.04 AS waste_variance,
 CASE WHEN c<4 THEN 12.5::DOUBLE ELSE 3.25::DOUBLE END AS avg_price, (actual-eng)*3 AS waste_cost, 3::BIGINT AS source_row, 2::BIGINT AS source_header_row
FROM (SELECT *, CASE WHEN c<5 THEN eng END AS e FROM ({_WASTE_FIELDS}))""")
def n13(spark, sf):
    w = ex.waste_detail(wb.workbook_cells(spark, sf, "waste_fields"))
    return w.select("*", F.col("evidence.source_row").cast("long").alias("source_row"), F.col("evidence.source_header_row").cast("long").alias("source_header_row")).drop("evidence", "sheet")


b.define("verified_resources", """SELECT b.*, CASE WHEN work_qty<>0 THEN actual_cost/work_qty END AS actual_rate
 FROM boq_resources b JOIN direct_codes c ON c.project=b.project AND c.main_code=b.main_code""", "boq_resources", "direct_codes")


def verified_resources(boq, codes):
    r = boq.join(codes, ["project", "main_code"])
    return r.withColumn("actual_rate", F.when(F.col("work_qty") != 0, F.col("actual_cost") / F.col("work_qty")))


@query("n14_boq_resources", sql_with("""
SELECT r.project AS file, 'Res '||r.main_code AS sheet, r.main_code, d.description, d.unit, CAST(CAST(regexp_extract(resource,'(\\d+)$',1) AS BIGINT) AS DOUBLE) AS no, resource,
 'R-'||CAST(regexp_extract(resource,'(\\d+)$',1) AS BIGINT) AS resource_code, actual_cost, work_qty,
 CASE WHEN CAST(substr(r.main_code,3) AS INT)%2=0 THEN actual_cost*2 WHEN work_qty<>0 THEN actual_cost/work_qty END AS actual_rate, eac,
 CASE WHEN CAST(substr(r.main_code,3) AS INT)%2=0 THEN 1.0::DOUBLE ELSE 0.833::DOUBLE END AS confidence, CAST(regexp_extract(resource,'(\\d+)$',1) AS BIGINT)+10 AS source_row, 4::BIGINT AS source_header_row
FROM boq_resources r JOIN (SELECT project, main_code, max_by(description, rank) AS description, max_by(lower(substr(division,1,1))||'2', rank) AS unit
 FROM (SELECT *, ascii(division)+ascii(substr(division,2,1)) AS rank FROM direct_details) GROUP BY 1,2) d ON d.project=r.project AND d.main_code=r.main_code""", "boq_resources", "direct_details"))
def n14(spark, sf):
    cells = wb.workbook_cells(spark, sf, "direct_units", "resources")
    found = ex.boq_resources(cells, ex.direct_details(cells))
    return found.select("*", F.col("evidence.mapping_confidence").alias("confidence"), F.col("evidence.source_row"), F.col("evidence.source_header_row").cast("long").alias("source_header_row")).drop("evidence", "row")


b.define("forecasts", """
SELECT project, main_code, division, '' AS resource, false AS is_resource, ev, bac, bac-ev AS remaining_budget,
 CASE WHEN final_qs_qty<>0 THEN eac/final_qs_qty END AS forecast_rate, etc FROM direct_details
UNION ALL SELECT r.project, r.main_code, d.division, r.resource, true, NULL, NULL, NULL,
 CASE WHEN r.eac IS NOT NULL AND d.final_qs_qty<>0 THEN r.eac/d.final_qs_qty WHEN work_qty<>0 THEN actual_cost/work_qty END,
 r.eac-actual_cost FROM verified_resources r LEFT JOIN (SELECT project, main_code, division, final_qs_qty FROM direct_details
 QUALIFY row_number() OVER (PARTITION BY project, main_code ORDER BY division DESC)=1) d ON d.project=r.project AND d.main_code=r.main_code""",
         "direct_details", "verified_resources")


def forecasts(spark, sf):
    lines = b.cost_cube(spark, sf, package="main_code division raw_di", resource="main_code resource raw_di")
    boq = verified_resources(b.boq_resources(spark, sf, lines["resource"]), direct_codes(lines["package"]))
    return nz.forecast_register(b.direct_details(spark, sf, lines["package"]), boq)


@query("n15_forecast_register", sql_with("SELECT * FROM forecasts", "forecasts"))
def n15(spark, sf):
    return forecasts(spark, sf)


@query("n17_cash_out_repair", sql_with(f"""
SELECT *, {RUN('coalesce(cash_in,0)')} AS cash_in_cum, {RUN('coalesce(cash_out,0)')} AS cash_out_cum FROM
(SELECT c.project, c.month, cash_in, CASE WHEN st='formula_error' AND ledger<>0 THEN ledger ELSE cash_out END AS cash_out,
 CASE WHEN st='formula_error' AND ledger<>0 THEN 'same_month_transaction_ledger' END AS cash_out_fallback FROM
 (SELECT project, month, cash_in, CASE WHEN month LIKE '%-06' THEN NULL ELSE cash_out END AS cash_out,
  CASE WHEN month LIKE '%-06' THEN 'formula_error' WHEN cash_out IS NULL THEN 'missing' ELSE 'value' END AS st FROM cash) c
 LEFT JOIN (SELECT project, month, {S('ac')} AS ledger FROM cost_lines GROUP BY 1,2) l ON l.project=c.project AND l.month=c.month)""", "cash"))
def n17(spark, sf):
    june = F.col("month").endswith("-06")
    flow = b.cash(spark, sf).select(
        "project", "month", "cash_in", F.when(~june, F.col("cash_out")).alias("cash_out"),
        F.when(june, "formula_error").when(F.col("cash_out").isNull(), "missing").otherwise("value").alias("cash_out_state"))
    ledger_months = b.cost_lines(spark, sf).groupBy("project", "month").agg(line_sum("ac").alias("total"))
    return nz.repair_cash_out(flow, ledger_months)


b.define("budget_candidates", """SELECT name AS project, 1 AS rank, 'Total Budget Cost' AS source_label, m_budget AS value FROM model
 UNION ALL SELECT name, 2, 'Direct  Budget (Cost):', k_direct_budget_cost FROM model WHERE regionkey=2
 UNION ALL SELECT name, 3, 'Indirect Budget Cost', k_ledger_raw_indirect FROM model WHERE regionkey=3""", "model")
b.define("kpis", f"""
SELECT m.name AS project, m_contract_value AS contract_price_dashboard, m_budget AS total_budget_cost,
 coalesce(CASE WHEN regionkey=2 THEN k_direct_budget_cost END,
  CASE WHEN coalesce(m_budget,0)=0 OR d.bud<=m_budget*1.05::DOUBLE THEN coalesce(d.bud,0) END) AS direct_budget_cost,
 coalesce(CASE WHEN regionkey=3 THEN k_ledger_raw_indirect END,
  CASE WHEN d.bud<>0 AND m_budget>=d.bud THEN m_budget-d.bud END) AS indirect_budget_cost,
 m_earned_value AS ev_dashboard_scope, m_actual_cost AS actual_cost_dashboard_scope,
 CASE WHEN d.ac<>0 AND regionkey=0 THEN d.ac WHEN regionkey=0 THEN NULL ELSE m_direct_cost END AS direct_actual,
 m_indirect_cost AS indirect_actual, CASE WHEN d.ac<>0 THEN d.ac END AS direct_detail_actual,
 CASE WHEN i.ac<>0 THEN i.ac END AS indirect_detail_actual, m_revenue AS revenue_gross_profit,
 CASE WHEN m_actual_cost<>0 THEN m_earned_value/m_actual_cost END AS derived_cpi,
 CASE WHEN m_actual_cost<>0 THEN m_earned_value-m_actual_cost END AS derived_cv,
 k_ledger_accounting_cost AS ledger_accounting_cost, k_ledger_raw_direct AS ledger_raw_direct, k_ledger_raw_indirect AS ledger_raw_indirect
FROM model m LEFT JOIN (SELECT project, {S('ac')} AS ac, {S('original_budget')} AS bud FROM direct_details GROUP BY 1) d ON d.project=m.name
LEFT JOIN (SELECT project, {S('ac')} AS ac FROM indirect_details GROUP BY 1) i ON i.project=m.name""",
         "model", "direct_details", "indirect_details")


def project_metrics(model):
    """Detected headline metrics; region 0 has no direct-cost headline."""
    return model.select(
        F.col("name").alias("project"), F.col("m_contract_value").alias("contract_value"), F.col("m_budget").alias("budget"),
        F.col("m_earned_value").alias("earned_value"), F.col("m_actual_cost").alias("actual_cost"),
        F.col("m_revenue").alias("revenue"), F.col("m_gross_profit").alias("gross_profit"),
        F.when(F.col("regionkey") != 0, F.col("m_direct_cost")).alias("direct_cost"), F.col("m_indirect_cost").alias("indirect_cost"))


def kpis(spark, sf):
    lines = b.cost_cube(spark, sf, time="month raw_di", package="main_code division raw_di")
    m = b.project_model(spark, sf, lines["time"])
    cand = m.select(F.col("name").alias("project"), "regionkey", F.inline(F.array(
        F.struct(F.lit(1).alias("rank"), F.lit("Total Budget Cost").alias("source_label"), F.col("m_budget").alias("value")),
        F.struct(F.lit(2).alias("rank"), F.lit("Direct  Budget (Cost):").alias("source_label"),
                 F.when(F.col("regionkey") == 2, F.col("k_direct_budget_cost")).alias("value")),
        F.struct(F.lit(3).alias("rank"), F.lit("Indirect Budget Cost").alias("source_label"),
                 F.when(F.col("regionkey") == 3, F.col("k_ledger_raw_indirect")).alias("value")))))
    metrics = (project_metrics(m)
               .join(nz.budget_component(cand, "direct budget cost", "direct_budget_component"), "project", "left")
               .join(nz.budget_component(cand, "indirect budget cost", "indirect_budget_component"), "project", "left"))
    totals = m.select(F.col("name").alias("project"), *[
        F.col(f"k_{c}").alias(c) for c in ("ledger_accounting_cost", "ledger_raw_direct", "ledger_raw_indirect")])
    return nz.kpi_block(metrics, b.direct_details(spark, sf, lines["package"]), b.indirect_details(spark, sf, lines["package"]), totals)


@query("n18_kpi_block", sql_with("SELECT * FROM kpis", "kpis"))
def n18(spark, sf):
    return kpis(spark, sf)


@query("n19_profitability", sql_with("""
SELECT name AS project, 'Detected Gross Profit' AS method, m_revenue AS base, m_gross_profit AS profit,
 CASE WHEN m_revenue<>0 THEN m_gross_profit/m_revenue END AS profit_pct FROM model WHERE m_gross_profit IS NOT NULL""", "model"))
def n19(spark, sf):
    return nz.detected_profitability(project_metrics(b.project_model(spark, sf)))


@query("n20_scope_reconciliation", sql_with("""
SELECT project, actual_cost_dashboard_scope AS dashboard_actual, direct_detail_actual, indirect_detail_actual,
 CASE WHEN direct_detail_actual IS NOT NULL OR indirect_detail_actual IS NOT NULL
  THEN coalesce(direct_detail_actual,0)+coalesce(indirect_detail_actual,0) END AS detail_total,
 ledger_accounting_cost AS ledger_actual, false AS forced_reconciliation FROM kpis""", "kpis"))
def n20(spark, sf):
    return nz.scope_reconciliation(kpis(spark, sf))


@query("n22_packed_ledger", sql_with(f"""
SELECT project, main_code, resource, source, di, (SELECT count(DISTINCT month) FROM ledger_months_detail) AS dense_months,
 count(*) AS filled_months, {S('total')} AS total, min(month) AS first_month, max(month) AS last_month FROM ledger_months_detail
GROUP BY project, main_code, resource, source, di""", "ledger_months_detail"))
def n22(spark, sf):
    ledger = b.ledger(spark, sf)
    names = nz.month_list(ledger)
    dense = nz.unpack_ledger(nz.pack_ledger(ledger, names), names)
    dense = dense.withColumn("filled", F.filter("months", lambda m: m["qty"].isNotNull()))
    paid = F.filter("months", lambda m: m["total"] != 0)  # a total of 0 adds nothing: only the others become decimals
    return dense.select(
        "project", "main_code", "resource", "source", "di", F.size("months").cast("long").alias("dense_months"),
        F.size("filled").cast("long").alias("filled_months"),
        F.aggregate(paid, F.lit(0).cast("decimal(38,6)"), lambda a, m: (a + m["total"].cast("decimal(28,6)")).cast("decimal(38,6)"))
        .cast("double").alias("total"),
        F.array_min(F.transform("filled", lambda m: m["month"])).alias("first_month"),
        F.array_max(F.transform("filled", lambda m: m["month"])).alias("last_month"))


@query("n23_flatten_records", sql_with("""
SELECT o_orderkey, o_orderkey AS k, o_totalprice AS v FROM orders UNION ALL SELECT o_orderkey, o_custkey, 1.5::DOUBLE FROM orders
UNION ALL SELECT o_orderkey, o_orderkey, 2.5::DOUBLE FROM orders"""))
def n23(spark, sf):
    def rec(k, v):
        return F.struct(k.alias("k"), v.alias("v"))

    doc = F.to_json(F.struct(
        F.struct(F.struct(F.struct(F.struct(F.struct(F.array(rec(F.col("o_orderkey"), F.col("o_totalprice"))).alias("rows")).alias("a")).alias("b")).alias("c")).alias("inner")).alias("header"),
        F.array(rec(F.col("o_custkey"), F.lit(1.5)), rec(F.col("o_orderkey"), F.lit(2.5))).alias("tags")))
    docs = b.table(spark, sf, "orders").select("o_orderkey", doc.alias("doc"))
    flat = nz.flatten_records(docs, "o_orderkey", "doc")
    return flat.select("o_orderkey", F.variant_get("record", "$.k", "bigint").alias("k"), F.variant_get("record", "$.v", "double").alias("v"))


@query("n24_object_table", sql_with("""
SELECT p_name AS name, p_brand AS brand, p_size AS size, 'part' AS record FROM part UNION ALL BY NAME
SELECT s_name AS name, s_acctbal AS balance, 'supplier' AS record FROM supplier UNION ALL BY NAME
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS record FROM customer"""))
def n24(spark, sf):
    part = b.table(spark, sf, "part").selectExpr("p_name AS name", "p_brand AS brand", "p_size AS size", "'part' AS record")
    sup = b.table(spark, sf, "supplier").selectExpr("s_name AS name", "s_acctbal AS balance", "'supplier' AS record")
    cust = b.table(spark, sf, "customer").selectExpr(
        "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment", "'customer' AS record")
    return nz.object_table([part, sup, cust])
