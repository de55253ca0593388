"""Registered project queries."""

from pyspark.sql import functions as F

from ledgerloom.functions import line_sum
from ledgerloom.operators import normalize as nz
from ledgerloom.operators import project as op
from ledgerloom.plans import bindings as b
from ledgerloom.plans.bindings import RUN, S, sql_with
from ledgerloom.plans.portfolio_queries import cards, history, quality, scoped
from ledgerloom.plans.registry import query

b.define("items", """
SELECT project, main_code, division, description AS item, original_budget, ev, ac, coalesce(cv,ev-ac) AS cv,
 CASE WHEN coalesce(cv,ev-ac)<0 THEN 'Over budget' WHEN coalesce(cv,ev-ac) IS NOT NULL THEN 'Under budget' ELSE 'Unavailable' END AS status_to_date,
 CASE WHEN ac<>0 THEN ev/ac WHEN ev=0 AND ac=0 THEN 1.0 END AS cpi_to_date,
 CASE WHEN final_qs_qty<>0 THEN work_qty/final_qs_qty ELSE invoice_pct END AS completion,
 bac, eac, etc, coalesce(vac,bac-eac) AS vac,
 CASE WHEN coalesce(vac,bac-eac)<0 THEN 'Over budget' WHEN coalesce(vac,bac-eac) IS NOT NULL THEN 'Under budget' ELSE 'Unavailable' END AS forecast_status,
 CASE WHEN eac<>0 THEN bac/eac END AS cpi_forecast FROM direct_details""", "direct_details")


def items(spark, sf):
    return nz.project_items(b.direct_details(spark, sf))


def unclassified(df):
    return df.withColumn("division", F.when(F.col("division") != "PROMO", F.col("division")))


@query("g01_division_rollup", sql_with(f"""
SELECT project, coalesce(nullif(division,'PROMO'),'Unclassified') AS division, {S('original_budget')} AS budget,
 {S('ev')} AS ev, {S('ac')} AS ac FROM items GROUP BY 1,2""", "items"))
def g01(spark, sf):
    return op.division_rollup(unclassified(items(spark, sf)))


@query("g02_performance_map", sql_with("""
SELECT project, main_code, division, completion*100 AS x, cpi_to_date AS y, original_budget AS size FROM items
WHERE cpi_to_date IS NOT NULL""", "items"))
def g02(spark, sf):
    return op.performance_points(items(spark, sf))


@query("g03_grouped_top_n", sql_with(f"""
SELECT project, name, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY value DESC, name) AS rank
 FROM (SELECT project, coalesce(nullif(division,'PROMO'),'Other') AS name, {S('ac')} AS value FROM items GROUP BY 1,2))
WHERE rank<=4""", "items"))
def g03(spark, sf):
    rows = unclassified(items(spark, sf))
    return op.top_n(op.grouped_total(rows, ["project"], F.col("division"), F.col("ac")), ["project"], F.col("value"), 4)


@query("g04_absolute_ranking", sql_with("""
SELECT project, name, value, rank FROM (SELECT project, item AS name, cv AS value,
 row_number() OVER (PARTITION BY project ORDER BY abs(cv) DESC, item) AS rank FROM items) WHERE rank<=16""", "items"))
def g04(spark, sf):
    rows = items(spark, sf).select("project", F.col("item").alias("name"), F.col("cv").alias("value"))
    return op.top_n(rows, ["project"], F.abs("value"), 16)


@query("g05_resource_pareto", sql_with(f"""
SELECT t.project, rank, name, value, {RUN('value', 't.project', 'rank')}/total AS cumulative_share FROM
(SELECT *, row_number() OVER (PARTITION BY project ORDER BY value DESC, name) AS rank FROM
 (SELECT project, resource AS name, {S('actual_cost')} AS value FROM boq_resources GROUP BY 1,2) QUALIFY rank<=16) t
JOIN (SELECT project, {S('actual_cost')} AS total FROM boq_resources GROUP BY 1) s ON s.project=t.project""", "boq_resources"))
def g05(spark, sf):
    return op.pareto(b.boq_resources(spark, sf), F.col("resource"), F.col("actual_cost"), 16)


b.define("conc", f"""SELECT project, count(*) AS row_count, {S('v')} AS total, max(v) AS top FROM (SELECT project,
 lower(trim(resource)) AS name, {S('actual_cost')} AS v FROM boq_resources WHERE actual_cost>0 GROUP BY 1,2) GROUP BY 1""",
         "boq_resources")


def resource_concentration(spark, sf):
    return op.concentration(b.boq_resources(spark, sf), ["project"], F.col("resource"), F.col("actual_cost"))


@query("g06_concentration", sql_with("SELECT * FROM conc", "conc"))
def g06(spark, sf):
    return resource_concentration(spark, sf)


@query("g07_source_mix", sql_with(f"""
SELECT g.project, name, value, CASE WHEN total<>0 THEN greatest(value,0)/total END AS share FROM
(SELECT project, source AS name, {S('total_cost')} AS value FROM ledger GROUP BY 1,2) g JOIN
(SELECT project, {S('total_cost')} AS total FROM ledger GROUP BY 1) t ON t.project=g.project""", "ledger"))
def g07(spark, sf):
    return op.source_mix(b.ledger_totals(spark, sf))


@query("g08_top_cost_codes", sql_with(f"""
SELECT project, name, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY value DESC, name) AS rank
 FROM (SELECT project, main_code AS name, {S('total_cost')} AS value FROM ledger GROUP BY 1,2)) WHERE rank<=15""", "ledger"))
def g08(spark, sf):
    g = op.grouped_total(b.ledger_totals(spark, sf), ["project"], F.col("main_code"), F.col("total_cost"))
    return op.top_n(g, ["project"], F.col("value"), 15)


@query("g09_ledger_trend", sql_with(f"SELECT project, month, {S('ac')} AS total FROM cost_lines GROUP BY 1,2", "cost_lines"))
def g09(spark, sf):
    return op.ledger_trend(b.ledger(spark, sf))


@query("g10_ledger_search", sql_with("""
SELECT project, main_code, resource, source, di, total_qty, total_cost FROM ledger
WHERE contains(lower(project||' '||main_code||' '||resource||' '||source),'000001') AND di='D' AND source='R'
ORDER BY 1,2,3,4,5 LIMIT 50 OFFSET 50""", "ledger"))
def g10(spark, sf):
    return op.ledger_page(b.ledger_totals(spark, sf), "000001", "D", "R", page=2)


@query("g11_transaction_months", sql_with("""
SELECT project, main_code, resource, source, di, month, qty, CASE WHEN qty<>0 THEN total/qty END AS unit_price, total
FROM ledger_months_detail""", "ledger_months_detail"))
def g11(spark, sf):
    return op.transaction_months(b.ledger(spark, sf))


@query("g12_source_list", sql_with(
    "SELECT source, row_number() OVER (ORDER BY source) AS ordinal FROM (SELECT DISTINCT l_returnflag AS source FROM lineitem)"))
def g12(spark, sf):
    return op.option_list(b.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("source")), "source")


@query("g13_table_view", sql_with("""
SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
WHERE contains(lower(p_name||' '||p_brand),'ring') AND p_type='PROMO' ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 25"""))
def g13(spark, sf):
    return op.table_view(b.table(spark, sf, "part"), ["p_name", "p_brand"], "RING", {"p_type": "PROMO"},
                         "p_retailprice", True, ["p_partkey"], page=2, size=25)


b.define("realloc", f"""SELECT project, main_code, {S("CASE WHEN source='A' THEN ac END")} AS other_cost,
 {S("CASE WHEN source='R' THEN ac END")} AS equipment FROM ledger_lines WHERE raw_di='I' GROUP BY 1,2""", "ledger_lines")
b.define("realloc_totals", f"""SELECT project, coalesce({S('other_cost')},0) AS other_cost_total,
 coalesce({S('equipment')},0) AS equipment_total, count(DISTINCT main_code) AS codes FROM realloc GROUP BY 1""", "realloc")


def reallocation(spark, sf):
    """Indirect cost to spread over codes: source A is other cost, source R is equipment."""
    lines = b.cost_lines(spark, sf, part=True).filter("raw_di = 'I'")
    return lines.groupBy("project", F.regexp_replace("main_code", "^Brand#", "B.").alias("main_code")).agg(
        line_sum(F.when(F.col("source") == "A", F.col("ac"))).alias("other_cost"),
        line_sum(F.when(F.col("source") == "R", F.col("ac"))).alias("equipment"))


@query("g14_classification_bridge", sql_with("""
SELECT name, level, label, value, reported-plus_other AS gap FROM (SELECT name, k_ledger_raw_direct AS raw,
  k_ledger_raw_direct+coalesce(equipment_total,0) AS plus_eq,
  k_ledger_raw_direct+coalesce(equipment_total,0)+coalesce(other_cost_total,0) AS plus_other, k_direct_actual AS reported
  FROM model LEFT JOIN realloc_totals r ON r.project=model.name),
 LATERAL (VALUES (1,'raw_direct',raw),(2,'plus_equipment',plus_eq),(3,'plus_other',plus_other),(4,'reported',reported)) v(level,label,value)
""", "model", "realloc_totals"))
def g14(spark, sf):
    return op.bridge(b.project_model(spark, sf), nz.reallocation_totals(reallocation(spark, sf)))


b.define("waste", f"""SELECT project, material, actual, engineering, actual-engineering AS waste_qty, actual_pct, 0.04::DOUBLE AS budget_pct
 FROM (SELECT *, CASE WHEN engineering<>0 THEN (actual-engineering)/engineering END AS actual_pct FROM (
 SELECT n_name AS project, CASE p_type WHEN 'STANDARD' THEN 'steel' ELSE 'concrete' END AS material,
 {S('l_quantity')} AS actual, {S('l_quantity*(1-l_discount)')} AS engineering FROM lineitem JOIN part ON l_partkey=p_partkey
 JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1,2))""")


def waste(spark, sf, lines=None):
    """Material consumption per project: STANDARD parts are steel, all others concrete. ``lines`` are joined lines with their parts."""
    g = ((lines if lines is not None else b.line_parts(spark, sf, part=True))
         .groupBy("project", F.when(F.col("division") == "STANDARD", "steel").otherwise("concrete").alias("material"))
         .agg(line_sum("l_quantity").alias("actual"),
              line_sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("engineering")))
    qty = F.col("actual") - F.col("engineering")
    return g.select("*", qty.alias("waste_qty"),
                    F.when(F.col("engineering") != 0, qty / F.col("engineering")).alias("actual_pct"),
                    F.lit(0.04).alias("budget_pct"))


b.define("waste_wide", """SELECT project, max(CASE WHEN material='steel' THEN actual_pct END) AS steel_actual,
 max(CASE WHEN material='steel' THEN budget_pct END) AS steel_budget,
 max(CASE WHEN material='concrete' THEN actual_pct END) AS concrete_actual,
 max(CASE WHEN material='concrete' THEN budget_pct END) AS concrete_budget FROM waste GROUP BY project""", "waste")


@query("g15_waste_efficiency", sql_with("SELECT * FROM waste_wide", "waste_wide"))
def g15(spark, sf):
    return op.waste_efficiency(waste(spark, sf))


@query("g16_cash_curve", sql_with("""
SELECT *, coalesce(cash_in,0)-coalesce(cash_out,0) AS net_cash, cash_in_cum-cash_out_cum AS cumulative_net FROM cashflow""", "cashflow"))
def g16(spark, sf):
    return op.cash_curve(b.cashflow(spark, sf))


@query("g17_reconciliation_listing", sql_with("""
SELECT name, ordinal, label, value FROM model, LATERAL (VALUES (1,'dashboard',k_actual_cost_dashboard_scope),
 (2,'direct detail',k_ledger_raw_direct),(3,'indirect detail',k_ledger_raw_indirect),(4,'ledger',k_ledger_accounting_cost)) v(ordinal,label,value)
""", "model"))
def g17(spark, sf):
    return op.stack_columns(b.project_model(spark, sf), "name", {
        "dashboard": "k_actual_cost_dashboard_scope", "direct detail": "k_ledger_raw_direct",
        "indirect detail": "k_ledger_raw_indirect", "ledger": "k_ledger_accounting_cost"})


@query("g18_headline_project_kpis", sql_with("""
SELECT name, ordinal, label, value FROM (SELECT name, coalesce(k_contract_price_dashboard,m_contract_value) AS contract,
 coalesce(k_total_budget_cost,m_budget) AS budget, coalesce(k_ev_dashboard_scope,m_earned_value) AS ev,
 coalesce(k_actual_cost_dashboard_scope,m_actual_cost) AS ac, coalesce(k_direct_actual,m_direct_cost) AS direct,
 coalesce(k_indirect_actual,m_indirect_cost) AS indirect, coalesce(k_revenue_gross_profit,m_revenue) AS revenue,
 k_ledger_accounting_cost AS ledger FROM model), LATERAL (VALUES (1,'contract',contract),(2,'budget',budget),(3,'ev',ev),(4,'ac',ac),
 (5,'cv',ev-ac),(6,'cpi',CASE WHEN ac<>0 THEN ev/ac END),(7,'direct',direct),(8,'indirect',indirect),(9,'revenue',revenue),
 (10,'ledger',ledger)) v(ordinal,label,value)""", "model"))
def g18(spark, sf):
    return op.headline_kpis(b.project_model(spark, sf))


@query("g19_cost_code_lookup", sql_with("""
SELECT DISTINCT regexp_replace(p_brand,'^Brand#','B.') AS code, p_type AS description FROM part
WHERE contains(lower(regexp_replace(p_brand,'^Brand#','B.')||' '||p_type),'b.2') ORDER BY 1,2"""))
def g19(spark, sf):
    codes = b.table(spark, sf, "part").select(
        F.regexp_replace("p_brand", "^Brand#", "B.").alias("code"), F.col("p_type").alias("description")).distinct()
    return codes.filter(F.lower(F.concat_ws(" ", "code", "description")).contains("b.2"))


@query("g20_indirect_pools", sql_with(f"""
SELECT project, division AS category, {S('ac')} AS cost, 'granular' AS classification FROM cost_lines WHERE raw_di='I' GROUP BY 1,2
UNION ALL SELECT project, source, {S('ac')}, 'official' FROM cost_lines WHERE raw_di='I' GROUP BY 1,2""", "cost_lines"))
def g20(spark, sf):
    lines = b.cost_lines(spark, sf, part=True).filter("raw_di = 'I'")
    granular = lines.groupBy("project", F.col("division").alias("category")).agg(line_sum("ac").alias("cost"))
    official = (b.cost_lines(spark, sf).filter("raw_di = 'I'")
                .groupBy("project", F.col("source").alias("category")).agg(line_sum("ac").alias("cost")))
    return op.pools_union(granular, official)


def report_sources(spark, sf):
    cells = b.cost_cube(spark, sf, time="month raw_di", package="main_code division raw_di", entry="main_code resource source raw_di month")
    time, package, entry = cells["time"], cells["package"], cells["entry"]
    m = b.project_model(spark, sf, time)
    direct, boq = b.direct_details(spark, sf, package), b.boq_resources(spark, sf, entry)
    return {
        "kpis": op.headline_kpis(m), "profitability": b.profit_methods(m), "cashflow": op.cash_curve(b.cashflow(spark, sf, time)),
        "data_quality": quality(spark, sf), "project_items": nz.project_items(direct), "direct_details": direct,
        "indirect_details": b.indirect_details(spark, sf, package), "boq_resources": boq,
        "boq_forecasts": nz.forecast_register(direct, boq), "waste": waste(spark, sf),
        "cost_codes": b.table(spark, sf, "part").select("p_brand", "p_type").distinct(),
        "ledger": b.ledger(spark, sf, entry), "history": history(spark, sf, time).select("project", F.explode("history").alias("h")),
        "scopes": op.stack_columns(m, "name", {"dashboard": "k_actual_cost_dashboard_scope", "ledger": "k_ledger_accounting_cost"}),
        "portfolio_matrix": scoped(spark, sf, lines=time), "cards": cards(spark, sf, time),
    }


def report_tables(spark, sf):
    """The six report datasets as named tables, ready to be written or shown."""
    return op.report_tables(report_sources(spark, sf))


EXEC = ["kpis", "profitability", "cashflow", "data_quality"]
DETAIL = EXEC + ["project_items", "direct_details", "indirect_details", "boq_resources", "boq_forecasts", "waste", "cost_codes"]
CONTENT = {"executive": EXEC, "detailed": DETAIL, "pack": DETAIL + ["ledger"], "monthly": ["history", "cashflow"],
           "reconciliation": ["scopes", "profitability", "data_quality"], "portfolio": ["portfolio_matrix"]}
COUNT_SQL = {
    "kpis": "SELECT 10*count(*) FROM model", "profitability": "SELECT count(*) FROM methods", "cashflow": "SELECT count(*) FROM cash",
    "data_quality": "SELECT count(*) FROM quality", "project_items": "SELECT count(*) FROM direct_details",
    "direct_details": "SELECT count(*) FROM direct_details", "indirect_details": "SELECT count(*) FROM indirect_details",
    "boq_resources": "SELECT count(*) FROM boq_resources",
    "boq_forecasts": "SELECT (SELECT count(*) FROM direct_details)+(SELECT count(*) FROM boq_resources)",
    "waste": "SELECT count(*) FROM waste", "cost_codes": "SELECT count(*) FROM (SELECT DISTINCT p_brand,p_type FROM part)",
    "ledger": "SELECT count(*) FROM ledger", "history": "SELECT count(*) FROM project_months",
    "scopes": "SELECT 2*count(*) FROM model", "portfolio_matrix": "SELECT count(*) FROM base"}


@query("g21_report_datasets", sql_with(" UNION ALL ".join(
    f"SELECT '{r}' AS report, '{t}' AS table_name, CAST(({COUNT_SQL[t]}) AS BIGINT) AS row_count"
    for r, ts in CONTENT.items() for t in ts),
    "methods", "cash", "quality", "direct_details", "indirect_details", "boq_resources", "waste", "ledger", "project_months", "base"))
def g21(spark, sf):
    return op.report_manifest(report_tables(spark, sf))
