"""Registered descriptor, risk-report and lineage queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import inline_table, ratio, total_sum
from ledgerloom.operators import normalize as nz
from ledgerloom.operators import portfolio as pf
from ledgerloom.operators import project as pj
from ledgerloom.operators import rules as op
from ledgerloom.operators.cube import measure_cube
from ledgerloom.plans import bindings as b
from ledgerloom.plans import contract as k
from ledgerloom.plans.bindings import S, sql_with
from ledgerloom.plans.normalize_queries import forecasts
from ledgerloom.plans.portfolio_queries import quality
from ledgerloom.plans.project_queries import reallocation, waste
from ledgerloom.plans.registry import query
from ledgerloom.plans.rules_queries import (
    CASH_RULE, CONC_RULE, COST_RULE, FC_RULE, IND_RULE, REC_RULE, TREND_RULE, WASTE_RULE, ledger_month_stats, quality_counts,
)
from ledgerloom.session import cut, dealt_to_groups, written

C = F.col

# ------------------------------------------------------------ dataset evidence

EVIDENCE_SQL = """
SELECT project, 'project_items' AS dataset, 'Direct Details' AS source_sheet, CAST(substr(main_code,3) AS INT)*100+ascii(division)-64 AS source_row, 0.9::DOUBLE AS mapping_confidence FROM direct_details
UNION ALL SELECT project, 'direct_details', 'Direct Details', CAST(substr(main_code,3) AS INT)*100+ascii(division)-64, 0.9 FROM direct_details
UNION ALL SELECT project, 'indirect_details', 'Indirect Details', CAST(substr(main_code,3) AS INT), 0.8 FROM indirect_details
UNION ALL SELECT project, 'boq_resources', 'BOQ '||main_code, CAST(regexp_extract(resource,'(\\d+)$',1) AS INT), 0.95 FROM boq_resources
UNION ALL SELECT project, 'boq_forecasts', 'Direct Details', CAST(substr(main_code,3) AS INT)*100+ascii(division)-64, 0.9 FROM direct_details
UNION ALL SELECT project, 'cashflow', 'Cashflow', NULL, 0.95 FROM cash
UNION ALL SELECT project, 'ledger_months', 'Expense Ledger', NULL, 0.7 FROM project_months
UNION ALL SELECT project, 'waste', 'Waste', NULL, 0.95 FROM waste
UNION ALL SELECT project, 'profitability', NULL, NULL, NULL FROM methods
UNION ALL SELECT project, 'data_quality', NULL, NULL, NULL FROM quality
UNION ALL SELECT n_name, 'supplier_accounts', 'Accounts', CAST(s_suppkey AS INT), 0.5 FROM supplier JOIN nation ON s_nationkey=n_nationkey"""
b.define("evidence", EVIDENCE_SQL, "direct_details", "indirect_details", "boq_resources", "cash", "project_months", "waste", "methods", "quality")


def evidence(spark, sf, lines, model):
    code = F.substring("main_code", 3, 9).cast("int")
    item_row = code * 100 + F.ascii("division") - 64
    direct = b.direct_details(spark, sf, lines["package"])

    def ev(df, name, sheet, row, conf):
        sheet = F.lit(sheet) if isinstance(sheet, str) or sheet is None else sheet
        row = row if row is not None else F.lit(None)
        return df.select("project", F.lit(name).alias("dataset"), sheet.cast("string").alias("source_sheet"),
                         row.cast("int").alias("source_row"), F.lit(conf).cast("double").alias("mapping_confidence"))

    suppliers = b.table(spark, sf, "supplier").join(
        b.table(spark, sf, "nation"), C("s_nationkey") == C("n_nationkey")).select(C("n_name").alias("project"), "s_suppkey")
    parts = [
        ev(direct, "project_items", "Direct Details", item_row, 0.9), ev(direct, "direct_details", "Direct Details", item_row, 0.9),
        ev(b.indirect_details(spark, sf, lines["package"]), "indirect_details", "Indirect Details", code, 0.8),
        ev(lines["boq"], "boq_resources", F.concat(F.lit("BOQ "), C("main_code")),
           F.regexp_extract("resource", r"(\d+)$", 1).cast("int"), 0.95),
        ev(direct, "boq_forecasts", "Direct Details", item_row, 0.9),
        ev(lines["cash"], "cashflow", "Cashflow", None, 0.95),
        ev(b.project_months(spark, sf, lines["time"]), "ledger_months", "Expense Ledger", None, 0.7),
        ev(lines["waste"], "waste", "Waste", None, 0.95),
        ev(b.profit_methods(model), "profitability", None, None, None),
        ev(lines["quality"], "data_quality", None, None, None),
        ev(suppliers, "supplier_accounts", "Accounts", C("s_suppkey"), 0.5),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


b.define("stats", """SELECT s.*, coalesce(p.n,0) AS n, p.places FROM (SELECT project, dataset, count(*) AS records, avg(mapping_confidence) AS confidence FROM evidence GROUP BY 1,2) s
 LEFT JOIN (SELECT project, dataset, count(*) AS n, list(place) AS places FROM (SELECT DISTINCT project, dataset, source_sheet, source_row,
  concat_ws(' row ',source_sheet,CAST(source_row AS VARCHAR)) AS place FROM evidence WHERE source_sheet IS NOT NULL) GROUP BY 1,2) p USING (project, dataset)""", "evidence")
METRIC_COLS = {"contract_value": "m_contract_value", "budget": "m_budget", "earned_value": "m_earned_value", "actual_cost": "m_actual_cost",
               "direct_cost": "m_direct_cost", "indirect_cost": "m_indirect_cost", "revenue": "m_revenue", "gross_profit": "m_gross_profit"}
b.define("metric_places", " UNION ALL ".join(
    f"SELECT name AS project, '{m}' AS metric, 'Dashboard {m}' AS location FROM model WHERE {c} IS NOT NULL" for m, c in METRIC_COLS.items()), "model")


def metric_places(model):
    items = [F.struct(F.lit(m).alias("metric"), F.lit(f"Dashboard {m}").alias("location"), C(c).isNotNull().alias("ok"))
             for m, c in METRIC_COLS.items()]
    return model.select(C("name").alias("project"), F.inline(F.array(*items))).filter("ok").select("project", "metric", "location")


def _binding_rows(rows):
    def q(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"

    return ",".join(
        f"({i},{q(r[0])},{q(r[1])},{q(r[2])},{q(r[3])},{'[' + ','.join(q(d) for d in r[4]) + ']::VARCHAR[]'})" for i, r in enumerate(rows))


PORTFOLIO_ROWS = [("Portfolio Command Center", *r) for r in k.PORTFOLIO_BINDINGS]
for _name, _rows in (("bind_project", k.PROJECT_BINDINGS), ("bind_portfolio", PORTFOLIO_ROWS)):
    b.define(_name, f"SELECT * FROM (VALUES {_binding_rows(_rows)}) v(ordinal,family,page,component,metric,datasets)")


def binding_table(spark, rows):
    flat = [(i, r[0], r[1], r[2], r[3], "|".join(r[4])) for i, r in enumerate(rows)]
    t = inline_table(spark, flat, ["ordinal", "family", "page", "component", "metric", "ds"])
    return t.withColumn("metric", C("metric").cast("string")).select(
        "ordinal", "family", "page", "component", "metric",
        F.filter(F.split("ds", r"\|"), lambda x: x != "").alias("datasets"))


b.define("lineage", """
SELECT p.project, bd.ordinal, family, page, component, coalesce(u.records,0) AS records,
 coalesce(u.n,0)+(location IS NOT NULL)::INT AS locations, u.confidence,
 CASE WHEN NOT (location IS NOT NULL OR coalesce(u.records,0)>0) THEN 'unavailable'
  WHEN coalesce(u.n,0)+(location IS NOT NULL)::INT>0 THEN 'wired' ELSE 'derived' END AS status
FROM (SELECT name AS project FROM model) p CROSS JOIN bind_project bd LEFT JOIN (SELECT project, ordinal, CAST(sum(records) AS BIGINT) AS records,
  sum(confidence*records)/sum(CASE WHEN confidence IS NOT NULL THEN records END) AS confidence,
  coalesce(len(list_distinct(flatten(list(places) FILTER (places IS NOT NULL)))),0) AS n
  FROM (SELECT ordinal, unnest(datasets) AS dataset FROM bind_project) d JOIN stats USING (dataset) GROUP BY 1,2) u ON u.project=p.project AND u.ordinal=bd.ordinal
LEFT JOIN metric_places m ON m.project=p.project AND m.metric=bd.metric
UNION ALL SELECT project, NULL, 'Source & Assurance', 'Data Mapping', 'Adaptive dataset · Supplier Accounts', records, n, confidence,
 CASE WHEN n>0 THEN 'adaptive' ELSE 'derived' END FROM stats WHERE dataset='supplier_accounts'""", "model", "bind_project", "stats", "metric_places")


def shared_cells(spark, sf):
    """Ledger cells at the three grains of the datasets below and what several of these read, each written once.

    The lines are joined once and stored: cells and waste are made of them. An entry has little more than one line, so lines are dealt to entries
    as they are, without partial sums. A written step leaves no shuffle files behind.
    """
    raw = b.stored_lines(spark, sf)
    full = b.with_supplier(spark, sf, raw)
    lines = measure_cube(b.amounts(full), {"time": b.level_keys("month raw_di"), "package": b.level_keys("main_code division raw_di")}, b.MEASURES, "cost-cells")
    dealt = dealt_to_groups(full, raw, "project", "main_code", "resource", "source")
    lines |= measure_cube(b.amounts(dealt), {"entry": b.level_keys("main_code resource source raw_di")}, ("bac", "ac", "work_qty"), "cost-entries")
    lines["model"] = written(b.project_model(spark, sf, lines["time"]), "project-model")
    lines["waste"] = written(waste(spark, sf, raw), "waste")
    lines["cash"] = written(b.cash(spark, sf, lines["time"]), "cash")
    lines["quality"] = written(quality(spark, sf).select("project", "severity"), "quality", source=raw)
    lines["boq"] = written(b.boq_resources(spark, sf, lines["entry"]), "boq-resources", source=lines["entry"])
    lines["evidence"] = written(evidence(spark, sf, lines, lines["model"]), "evidence")
    return lines


def lineage_rows(spark, sf, lines=None, stats=None, with_evidence=False):
    lines = lines if lines is not None else shared_cells(spark, sf)
    m, told = lines["model"], lines["evidence"]
    stats = stats if stats is not None else op.dataset_stats(told)
    bind, projects = binding_table(spark, k.PROJECT_BINDINGS), m.select(C("name").alias("project"), C("id").alias("project_id"))
    first = op.first_places(told) if with_evidence else None
    return op.lineage(bind, projects, stats, op.evidence_places(told), metric_places(m), first).unionByName(op.adaptive_lineage(bind, stats, projects, first))


LIN_OUT = "project, ordinal, family, page, component, records, locations, round(confidence,6) AS confidence, status"
b.define("first_places", """SELECT project, dataset, rank, place FROM (SELECT *, row_number() OVER (PARTITION BY project, dataset ORDER BY source_sheet, source_row NULLS FIRST) AS rank FROM
 (SELECT DISTINCT project, dataset, source_sheet, source_row, concat_ws(' · row ',source_sheet,CAST(source_row AS VARCHAR)) AS place FROM evidence WHERE source_sheet<>'')) WHERE rank<=12""", "evidence")
_PATH = "'/generated/projects/'||id||'/latest.json"


def _paths_sql(preferred: str) -> str:
    return (f"list_concat(CASE WHEN metric IS NULL THEN []::VARCHAR[] ELSE [{_PATH}#/metrics/'||metric{preferred}] END, "
            f"list_transform(datasets, lambda d: {_PATH}#/normalized_path#/'||d))")


# the metric's place stands first, then the first twelve distinct places of the datasets in their order
b.define("lineage_evidence", f"""SELECT p.project, p.ordinal, list_concat(CASE WHEN location IS NULL THEN []::VARCHAR[] ELSE [location] END, coalesce(places,[]::VARCHAR[])) AS evidence, paths FROM
 (SELECT name AS project, ordinal, metric, {_paths_sql("||'/preferred'")} AS paths FROM model CROSS JOIN bind_project) p
 LEFT JOIN (SELECT project, ordinal, list(place ORDER BY o) AS places FROM (SELECT project, ordinal, place, min(pos*100+rank) AS o, row_number() OVER (PARTITION BY project, ordinal ORDER BY min(pos*100+rank)) AS n
  FROM (SELECT ordinal, unnest(datasets) AS dataset, generate_subscripts(datasets,1) AS pos FROM bind_project) d JOIN first_places f USING (dataset) GROUP BY project, ordinal, place) WHERE n<=12 GROUP BY 1,2) f
  ON f.project=p.project AND f.ordinal=p.ordinal LEFT JOIN metric_places m ON m.project=p.project AND m.metric=p.metric
UNION ALL SELECT project, NULL, list(place ORDER BY rank), any_value([{_PATH}#/normalized_path#/supplier_accounts']) FROM first_places JOIN model ON name=project WHERE dataset='supplier_accounts' GROUP BY 1""",
         "model", "bind_project", "first_places", "metric_places")


@query("r31_project_lineage", sql_with(f"SELECT {LIN_OUT.replace('locations,', 'CAST(locations AS BIGINT) AS locations,')}, evidence, paths FROM lineage JOIN (SELECT project AS p, ordinal AS o, evidence, paths FROM lineage_evidence) ON p=project AND o IS NOT DISTINCT FROM ordinal",
                                     "lineage", "lineage_evidence"))
def r31(spark, sf):
    return lineage_rows(spark, sf, with_evidence=True).withColumn("confidence", F.round("confidence", 6))


@query("r32_portfolio_lineage", sql_with(f"""
SELECT p.project, bd.ordinal, page, component, coalesce(u.records,0) AS records, {_paths_sql("")} AS evidence,
 CASE WHEN component='Selected Projects' OR coalesce(u.records,0)>0 OR m.location IS NOT NULL THEN 'derived' ELSE 'unavailable' END AS status
FROM (SELECT name AS project, id FROM model) p CROSS JOIN bind_portfolio bd LEFT JOIN (SELECT project, ordinal, CAST(sum(records) AS BIGINT) AS records
 FROM (SELECT ordinal, unnest(datasets) AS dataset FROM bind_portfolio) d JOIN stats USING (dataset) GROUP BY 1,2) u ON u.project=p.project AND u.ordinal=bd.ordinal
LEFT JOIN (SELECT project, metric AS name, location FROM metric_places) m ON m.project=p.project AND m.name=bd.metric""", "model", "bind_portfolio", "stats", "metric_places"))
def r32(spark, sf):
    lines = shared_cells(spark, sf)
    m, told = lines["model"], lines["evidence"]
    stats = op.dataset_stats(told)
    bind, ids = binding_table(spark, PORTFOLIO_ROWS), m.select(C("name").alias("project"), C("id").alias("project_id"))
    rows = op.lineage(bind, ids.select("project"), stats, op.evidence_places(told), metric_places(m))
    # the inputs of a portfolio output are the places of its values in the projects' documents
    rows = rows.join(bind.select("ordinal", "metric", "datasets"), "ordinal").join(ids, "project").withColumn("evidence", op.json_paths("project_id", "metric", "datasets", preferred=False))
    status = F.when((C("component") == "Selected Projects") | (C("status") != "unavailable"), "derived").otherwise("unavailable")
    return rows.select("project", "ordinal", "page", "component", "records", "evidence", status.alias("status"))


@query("r34_lineage_search", sql_with("""
SELECT status, count(*) AS n, count(*) FILTER (contains(lower(concat_ws(' ',family,page,component)),'cost')) AS matching FROM lineage GROUP BY status""", "lineage"))
def r34(spark, sf):
    text = F.lower(F.concat_ws(" ", "family", "page", "component"))
    return lineage_rows(spark, sf).groupBy("status").agg(
        F.count("*").alias("n"), F.count_if(text.contains("cost")).alias("matching"))


# --------------------------------------------------------------------- facts

b.define("facts", f"""
SELECT m.name AS project, m.id, m.period, m.regionkey, 0::DOUBLE AS zero, coalesce(k_contract_price_dashboard,m_contract_value) AS contract,
 coalesce(k_total_budget_cost,m_budget) AS budget, coalesce(k_ev_dashboard_scope,m_earned_value) AS ev, coalesce(k_actual_cost_dashboard_scope,m_actual_cost) AS ac,
 coalesce(k_ev_dashboard_scope,m_earned_value)-coalesce(k_actual_cost_dashboard_scope,m_actual_cost) AS cv,
 CASE WHEN coalesce(k_actual_cost_dashboard_scope,m_actual_cost)<>0 THEN coalesce(k_ev_dashboard_scope,m_earned_value)/coalesce(k_actual_cost_dashboard_scope,m_actual_cost) END AS cpi,
 coalesce(k_direct_actual,m_direct_cost) AS direct, coalesce(k_indirect_actual,m_indirect_cost) AS indirect, coalesce(k_revenue_gross_profit,m_revenue) AS revenue,
 k_ledger_accounting_cost AS ledger, k_direct_actual AS direct_kpi, k_actual_cost_dashboard_scope AS ac_kpi, k_ledger_raw_direct AS raw_direct, k_ledger_raw_indirect AS raw_indirect,
 k_indirect_budget_cost AS indirect_budget_kpi, k_indirect_actual AS indirect_kpi, k_indirect_budget_cost-k_indirect_actual AS indirect_variance,
 bs.gp AS base_gp, CASE WHEN bs.revenue<>0 THEN bs.gp/bs.revenue END AS base_margin,
 it.item_rows, it.item_adverse, mc.methods AS method_count, mc.losses, mc.misses, cs.cash_periods, cs.cash_negative, cs.last_cash_in, cs.last_cash_out,
 cs.last_cash_in-cs.last_cash_out AS last_cash_net, cs.cum_in, cs.cum_out, cs.cum_in-cs.cum_out AS cum_net,
 t.slope, t.r_squared, t.forecast_next_net, t.max_residual_z, t.last_net, cn.row_count AS res_rows, cn.total AS res_total, cn.top AS res_top,
 w.steel_actual, w.steel_budget, w.concrete_actual, w.concrete_budget,
 k_ledger_raw_direct+coalesce(rt.equipment_total,0)+coalesce(rt.other_cost_total,0) AS bridge_accounting,
 fs.row_count AS fc_rows, fs.bac AS fc_bac, fs.ev AS fc_ev, fs.etc AS fc_etc, fs.remaining_budget AS fc_remaining,
 it.item_rows AS dd_rows, it.dd_budget, it.dd_ev, it.dd_ac, idd.*  EXCLUDE (project), pl.pool_rows, pl.pool_total, al.alloc_rows, al.alloc_actual,
 rt.equipment_total AS alloc_equipment, rt.other_cost_total AS alloc_other, ws.waste_rows, lm.periods AS lm_periods, lm.last_total AS lm_latest, lm.total AS lm_total,
 sm.src_count, cc.code_rows, cc.code_total, cc.code_top, ex.exp_rows, q.findings, q.severe, q.warnings, mf.sheets, mf.tables, mf.cells,
 lk.links, lk.exact_links, lk.missing_links
FROM model m JOIN base bs ON bs.name=m.name
LEFT JOIN (SELECT project, count(*) AS item_rows, count(*) FILTER (cpi_to_date<1) AS item_adverse, {S('original_budget')} AS dd_budget, {S('ev')} AS dd_ev, {S('ac')} AS dd_ac FROM items GROUP BY 1) it ON it.project=m.name
LEFT JOIN method_counts mc ON mc.project=m.name
LEFT JOIN (SELECT project, count(*) AS cash_periods, count(*) FILTER (coalesce(cash_in,0)-coalesce(cash_out,0)<0) AS cash_negative,
  (max({{'m':month,'v':cash_in}})).v AS last_cash_in, (max({{'m':month,'v':cash_out}})).v AS last_cash_out, (max({{'m':month,'v':cash_in_cum}})).v AS cum_in, (max({{'m':month,'v':cash_out_cum}})).v AS cum_out FROM cashflow GROUP BY 1) cs ON cs.project=m.name
LEFT JOIN trend t ON t.project=m.name LEFT JOIN conc cn ON cn.project=m.name LEFT JOIN waste_wide w ON w.project=m.name
LEFT JOIN realloc_totals rt ON rt.project=m.name LEFT JOIN forecast_sums fs ON fs.project=m.name
LEFT JOIN (SELECT project, count(*) AS id_rows, {S('original_budget')} AS id_budget, {S('ev')} AS id_ev, {S('ac')} AS id_ac, {S('cv')} AS id_cv FROM indirect_details GROUP BY 1) idd ON idd.project=m.name
LEFT JOIN (SELECT project, count(DISTINCT division)+count(DISTINCT source) AS pool_rows, {S('ac')}*2 AS pool_total FROM ledger_lines WHERE raw_di='I' GROUP BY 1) pl ON pl.project=m.name
LEFT JOIN (SELECT project, count(*) AS alloc_rows, {S('actual_cost')} AS alloc_actual FROM boq_resources GROUP BY 1) al ON al.project=m.name
LEFT JOIN (SELECT project, count(*) AS waste_rows FROM waste GROUP BY 1) ws ON ws.project=m.name
LEFT JOIN ledger_month_stats lm ON lm.project=m.name
LEFT JOIN (SELECT project, count(DISTINCT source) AS src_count FROM ledger_lines GROUP BY 1) sm ON sm.project=m.name
LEFT JOIN (SELECT project, count(*) AS code_rows, {S('v')} AS code_total, max(v) AS code_top FROM (SELECT project, main_code, {S('ac')} AS v FROM ledger_lines GROUP BY 1,2) WHERE v>0 GROUP BY 1) cc ON cc.project=m.name
LEFT JOIN (SELECT project, count(*) AS exp_rows FROM ledger GROUP BY 1) ex ON ex.project=m.name
LEFT JOIN quality_counts q ON q.project=m.name
LEFT JOIN (SELECT project, count(DISTINCT main_code) AS sheets, count(DISTINCT division) AS tables, count(*) AS cells FROM ledger_lines GROUP BY 1) mf ON mf.project=m.name
LEFT JOIN (SELECT project, count(*) AS links, count(*) FILTER (status IN ('wired','adaptive')) AS exact_links, count(*) FILTER (status='unavailable') AS missing_links FROM lineage GROUP BY 1) lk ON lk.project=m.name""",
         "base", "items", "method_counts", "cashflow", "trend", "conc", "waste_wide", "realloc_totals", "forecast_sums", "indirect_details",
         "boq_resources", "ledger_month_stats", "ledger", "quality_counts", "lineage")


def project_facts(spark, sf, lines=None, lineage=None):
    """Every metric of every project component: one row per project."""
    lines = lines if lines is not None else shared_cells(spark, sf)
    m = lines["model"]
    package, entry = lines["package"], lines["entry"]
    direct, boq = b.direct_details(spark, sf, package), lines["boq"]
    flow = b.cashflow(spark, sf, flow=lines["cash"])
    methods = b.profit_methods(m)
    bs = pf.base_rows(b.with_methods(m)).select(C("name").alias("project"), C("gp").alias("base_gp"), ratio("gp", "revenue").alias("base_margin"))
    c = F.coalesce
    ev, ac = c("k_ev_dashboard_scope", "m_earned_value"), c("k_actual_cost_dashboard_scope", "m_actual_cost")
    out = m.select(
        C("name").alias("project"), "id", "period", "regionkey", F.lit(0.0).alias("zero"),
        c("k_contract_price_dashboard", "m_contract_value").alias("contract"), c("k_total_budget_cost", "m_budget").alias("budget"),
        ev.alias("ev"), ac.alias("ac"), (ev - ac).alias("cv"), ratio(ev, ac).alias("cpi"),
        c("k_direct_actual", "m_direct_cost").alias("direct"), c("k_indirect_actual", "m_indirect_cost").alias("indirect"),
        c("k_revenue_gross_profit", "m_revenue").alias("revenue"), C("k_ledger_accounting_cost").alias("ledger"),
        C("k_direct_actual").alias("direct_kpi"), C("k_actual_cost_dashboard_scope").alias("ac_kpi"),
        C("k_ledger_raw_direct").alias("raw_direct"), C("k_ledger_raw_indirect").alias("raw_indirect"),
        C("k_indirect_budget_cost").alias("indirect_budget_kpi"), C("k_indirect_actual").alias("indirect_kpi"),
        (C("k_indirect_budget_cost") - C("k_indirect_actual")).alias("indirect_variance"))
    items = nz.project_items(direct).groupBy("project").agg(
        F.count("*").alias("item_rows"), F.count_if(C("cpi_to_date") < 1).alias("item_adverse"), F.count("*").alias("dd_rows"),
        total_sum("original_budget").alias("dd_budget"), total_sum("ev").alias("dd_ev"), total_sum("ac").alias("dd_ac"))
    mc = op.method_counts(methods).withColumnRenamed("methods", "method_count")
    last = F.max_by(F.struct("cash_in", "cash_out", "cash_in_cum", "cash_out_cum"), "month")
    z = F.lit(0.0)
    cs = flow.groupBy("project").agg(
        F.count("*").alias("cash_periods"), F.count_if(c("cash_in", z) - c("cash_out", z) < 0).alias("cash_negative"), last.alias("l")
    ).select("project", "cash_periods", "cash_negative", C("l.cash_in").alias("last_cash_in"), C("l.cash_out").alias("last_cash_out"),
             (C("l.cash_in") - C("l.cash_out")).alias("last_cash_net"), C("l.cash_in_cum").alias("cum_in"), C("l.cash_out_cum").alias("cum_out"),
             (C("l.cash_in_cum") - C("l.cash_out_cum")).alias("cum_net"))
    tr = op.cash_trend_metrics(flow).select("project", "slope", "r_squared", "forecast_next_net", "max_residual_z", "last_net")
    conc = pj.concentration(boq, ["project"], C("resource"), C("actual_cost")).select(
        "project", C("row_count").alias("res_rows"), C("total").alias("res_total"), C("top").alias("res_top"))
    wst = lines["waste"]
    realloc = entry.filter("raw_di = 'I'").groupBy("project", "main_code").agg(
        b.line_sum(F.when(C("source") == "A", C("ac"))).alias("other_cost"), b.line_sum(F.when(C("source") == "R", C("ac"))).alias("equipment"))
    rt = nz.reallocation_totals(realloc).select(
        "project", C("equipment_total").alias("alloc_equipment"), C("other_cost_total").alias("alloc_other"))
    verified = package.groupBy("project", "main_code").agg(
        b.line_sum(F.when(C("raw_di") == "D", C("bac"))).alias("d"), b.line_sum(F.when(C("raw_di") == "I", C("bac"))).alias("i")
    ).filter("d >= coalesce(i, 0D)").select("project", "main_code")
    fc = nz.forecast_register(direct, boq.join(verified, ["project", "main_code"])).groupBy("project").agg(
        F.count("*").alias("fc_rows"), total_sum("bac").alias("fc_bac"), total_sum("ev").alias("fc_ev"), total_sum("etc").alias("fc_etc"),
        total_sum("remaining_budget").alias("fc_remaining"))
    idd = b.indirect_details(spark, sf, package).groupBy("project").agg(
        F.count("*").alias("id_rows"), *[total_sum(x).alias(f"id_{n}") for n, x in (("budget", "original_budget"), ("ev", "ev"), ("ac", "ac"), ("cv", "cv"))])
    pools = package.filter("raw_di = 'I'").groupBy("project").agg(F.countDistinct("division").alias("divisions"), (b.line_sum("ac") * 2).alias("pool_total")).join(
        entry.filter("raw_di = 'I'").groupBy("project").agg(F.countDistinct("source").alias("sources")), "project").select(
        "project", (C("divisions") + C("sources")).alias("pool_rows"), "pool_total")
    al = boq.groupBy("project").agg(F.count("*").alias("alloc_rows"), total_sum("actual_cost").alias("alloc_actual"))
    ws = wst.groupBy("project").agg(F.count("*").alias("waste_rows"))
    lm = ledger_month_stats(lines["time"].groupBy("project", "month").agg(b.line_sum("ac").alias("total"))).select(
        "project", C("periods").alias("lm_periods"), C("last_total").alias("lm_latest"), C("total").alias("lm_total"))
    by_code = package.groupBy("project", "main_code").agg(b.line_sum("ac").alias("v")).filter("v > 0").groupBy("project").agg(
        F.count("*").alias("code_rows"), total_sum("v").alias("code_total"), F.max("v").alias("code_top"))
    exp = entry.groupBy("project").agg(F.count("*").alias("exp_rows"), F.countDistinct("source").alias("src_count"))
    mf = package.groupBy("project").agg(
        F.countDistinct("main_code").alias("sheets"), F.countDistinct("division").alias("tables"), F.sum("n").alias("cells"))
    lineage = lineage if lineage is not None else lineage_rows(spark, sf, lines)
    lk = lineage.groupBy("project").agg(
        F.count("*").alias("links"), F.count_if(C("status").isin("wired", "adaptive")).alias("exact_links"),
        F.count_if(C("status") == "unavailable").alias("missing_links"))
    for part in (bs, items, mc, cs, tr, conc, pj.waste_efficiency(wst), rt, fc, idd, pools, al, ws, lm, by_code, exp,
                 quality_counts(spark, sf, m, lines["quality"]), mf, lk):
        out = out.join(part, "project", "left")
    return out.withColumn("bridge_accounting", C("raw_direct") + c("alloc_equipment", z) + c("alloc_other", z))


def _confidence():
    return F.when(C("regionkey") == 4, 1.0).otherwise(0.86)


def _metrics(spec):
    return F.create_map(*[x for name, col in spec.items() for x in (F.lit(name), C(col).cast("double"))])


def project_descriptors(facts):
    """Components of the 16 project surfaces; waste detail and data quality follow their evidence."""
    items = [F.struct(
        F.lit(i).alias("ordinal"), F.lit(s).alias("surface"), F.lit(cid).alias("component_id"), F.lit(name).alias("component_name"),
        F.lit(kind).alias("kind"), F.lit(sem).alias("semantic_type"), _metrics(spec).alias("metrics"))
        for i, (s, cid, name, kind, sem, spec) in enumerate(k.PROJECT_COMPONENTS)]
    rows = facts.select(C("id").alias("project_id"), C("project").alias("project_name"), "period", _confidence().alias("confidence"),
                        C("waste_rows").alias("_w"), F.inline(F.array(*items)))
    return rows.filter((C("component_id") != "waste-detail") | (C("_w") > 0)).drop("_w")


def _values_sql(components):
    return ",".join(f"({i},'{c[0]}','{c[1]}','{c[4]}','{m}',CAST({f} AS DOUBLE))"
                    for i, c in enumerate(components) for m, f in c[5].items())


b.define("desc_long", f"""SELECT id AS project_id, project AS project_name, ordinal, surface, component_id, semantic_type, metric, value FROM facts,
 LATERAL (VALUES {_values_sql(k.PROJECT_COMPONENTS)}) v(ordinal,surface,component_id,semantic_type,metric,value)""", "facts")


def _long(desc, *keys):
    """Metric rows; fitted values are rounded where they are not exact."""
    rows = desc.select(*keys, "ordinal", "surface", "component_id", "semantic_type", F.explode("metrics").alias("metric", "v"))
    return rows.select(*keys, "ordinal", "surface", "component_id", "semantic_type", "metric", F.round("v", 2).alias("value"))


@query("r19_project_descriptors", sql_with(
    "SELECT project_name, ordinal, surface, component_id, semantic_type, metric, round(value,2) AS value FROM desc_long", "desc_long"))
def r19(spark, sf):
    return _long(project_descriptors(project_facts(spark, sf)), "project_name")


# ------------------------------------------------------------------ portfolio

STRESS = (0.0, 100.0, 0.0)
b.define("pfacts", f"""SELECT budget, ev, ac, ev-ac AS cv, CASE WHEN ac<>0 THEN ev/ac END AS cpi, revenue, gp, CASE WHEN revenue<>0 THEN gp/revenue END AS margin,
 direct, indirect, p_count, p_count AS p_registered, p_adverse, p_periods, p_negative, p_last_in, p_last_out, p_last_in-p_last_out AS p_last_net, p_cum_in, p_cum_out,
 p_cum_in-p_cum_out AS p_cum_net, eac AS s_eac, price-eac AS s_profit, (price-eac)/price AS s_margin,
 p_revisions, p_findings, p_severe, greatest(p_findings-p_severe,0) AS p_warnings, 6 AS p_reports FROM
 (SELECT {S('budget')} AS budget, {S('ev')} AS ev, {S('ac')} AS ac, {S('revenue')} AS revenue, {S('gp')} AS gp, {S('direct_ac')} AS direct, {S('indirect_ac')} AS indirect,
  count(*) AS p_count, count(*) FILTER (cpi<1) AS p_adverse, {S('price')} AS price, {S('ac')}+{S('greatest(0,budget-ev)')}*1+{S('indirect_ac')}*0 AS eac FROM scoped),
 (SELECT count(DISTINCT month) AS p_periods, count(*) FILTER (cash_in-cash_out<0) AS p_negative FROM cashflow),
 (SELECT CASE WHEN bool_and(cash_in IS NOT NULL AND cash_out IS NOT NULL) THEN {S('cash_in')} END AS p_last_in,
   CASE WHEN bool_and(cash_in IS NOT NULL AND cash_out IS NOT NULL) THEN {S('cash_out')} END AS p_last_out, {S('cash_in_cum')} AS p_cum_in, {S('cash_out_cum')} AS p_cum_out
  FROM (SELECT * FROM cashflow QUALIFY row_number() OVER (PARTITION BY project ORDER BY month DESC)=1)),
 (SELECT count(*) AS p_revisions FROM project_months), (SELECT CAST(sum(findings) AS BIGINT) AS p_findings, CAST(sum(severe) AS BIGINT) AS p_severe FROM quality_counts)""",
         "scoped", "cashflow", "project_months", "quality_counts")
b.define("pdesc_long", f"""SELECT ordinal, surface, surface||'-'||component_id AS component_id, semantic_type, metric, value FROM pfacts,
 LATERAL (VALUES {_values_sql(k.PORTFOLIO_COMPONENTS)}) v(ordinal,surface,component_id,semantic_type,metric,value)""", "pfacts")
RISK_SURFACE = "SELECT ordinal+100 AS ordinal, 'risk' AS surface, 'risk-'||component_id AS component_id, semantic_type, metric, value FROM pdesc_long WHERE surface IN ('charts','analysis') AND semantic_type<>'scenario'"


def portfolio_facts(spark, sf, months, shared=None):
    """One row of portfolio measures from the monthly cells; model, cash and quality are those of ``shared``, where given."""
    shared = shared or {}
    m = shared["model"] if shared else b.project_model(spark, sf, months)
    rows = pf.scoped(pf.base_rows(b.with_methods(m)))
    flow = b.cashflow(spark, sf, months, shared.get("cash"))
    rem = F.greatest(F.lit(0.0), C("budget") - C("ev"))
    sums = rows.agg(
        *[total_sum(x).alias(n) for n, x in (("budget", "budget"), ("ev", "ev"), ("ac", "ac"), ("revenue", "revenue"), ("gp", "gp"),
                                             ("direct", "direct_ac"), ("indirect", "indirect_ac"), ("price", "price"))],
        total_sum(rem).alias("rem"), F.count("*").alias("p_count"), F.count_if(C("cpi") < 1).alias("p_adverse"))
    cash = flow.agg(F.countDistinct("month").alias("p_periods"), F.count_if(C("cash_in") - C("cash_out") < 0).alias("p_negative"))
    last = pf.latest_cash(flow).select(
        C("latest_cash_in").alias("p_last_in"), C("latest_cash_out").alias("p_last_out"),
        C("cumulative_cash_in").alias("p_cum_in"), C("cumulative_cash_out").alias("p_cum_out"), C("cumulative_net").alias("p_cum_net"))
    revisions = b.project_months(spark, sf, months).agg(F.count("*").alias("p_revisions"))
    q = quality_counts(spark, sf, m, shared.get("quality")).agg(F.sum("findings").alias("p_findings"), F.sum("severe").alias("p_severe"))
    out = sums
    for part in (cash, last, revisions, q):
        out = out.join(part, how="cross")  # one-row aggregates
    eac = C("ac") + C("rem") * (1 + STRESS[0] / 100) + C("indirect") * (STRESS[2] / 100)
    return out.select(
        "*", (C("ev") - C("ac")).alias("cv"), ratio("ev", "ac").alias("cpi"), ratio("gp", "revenue").alias("margin"),
        C("p_count").alias("p_registered"), (C("p_last_in") - C("p_last_out")).alias("p_last_net"), eac.alias("s_eac"),
        (C("price") - eac).alias("s_profit"), ratio(C("price") - eac, C("price")).alias("s_margin"),
        F.greatest(C("p_findings") - C("p_severe"), F.lit(0)).alias("p_warnings"), F.lit(6).alias("p_reports"))


def portfolio_descriptors(facts, period):
    """Six portfolio views; the risk view is charts plus analysis without the scenario, once per id."""
    items = [F.struct(
        F.lit(i).alias("ordinal"), F.lit(s).alias("surface"), F.lit(f"{s}-{cid}").alias("component_id"), F.lit(name).alias("component_name"),
        F.lit(kind).alias("kind"), F.lit(sem).alias("semantic_type"), _metrics(spec).alias("metrics"))
        for i, (s, cid, name, kind, sem, spec) in enumerate(k.PORTFOLIO_COMPONENTS)]
    rows = facts.join(period, how="cross").select(
        F.lit("portfolio").alias("project_id"), F.lit("portfolio").alias("project_name"), "period", F.lit(0.9).alias("confidence"),
        F.inline(F.array(*items)))
    risk = rows.filter(C("surface").isin("charts", "analysis") & (C("semantic_type") != "scenario")).dropDuplicates(["component_id"]).select(
        "project_id", "project_name", "period", "confidence", (C("ordinal") + 100).alias("ordinal"), F.lit("risk").alias("surface"),
        F.concat(F.lit("risk-"), C("component_id")).alias("component_id"), "component_name", "kind", "semantic_type", "metrics")
    return rows.unionByName(risk)


def portfolio_components(spark, sf, shared=None):
    months = shared["time"] if shared else b.cost_cube(spark, sf, ("bac", "ev", "ac"), time="month raw_di")["time"]
    return portfolio_descriptors(portfolio_facts(spark, sf, months, shared), months.agg(F.max("month").alias("period")))


@query("r20_portfolio_descriptors", sql_with(f"""
SELECT ordinal, surface, component_id, semantic_type, metric, round(value,2) AS value FROM
(SELECT * FROM pdesc_long UNION ALL {RISK_SURFACE})""", "pdesc_long"))
def r20(spark, sf):
    d = portfolio_components(spark, sf)
    return _long(d)


@query("r21_application_coverage", sql_with(f"""
SELECT expected, least(expected,covered) AS covered, least(100,covered/expected*100) AS coverage_pct, gaps FROM
(SELECT (SELECT count(*) FROM model)*16+6 AS expected, (SELECT count(DISTINCT project_id||surface) FROM desc_long)+(SELECT count(DISTINCT surface) FROM pdesc_long)+1 AS covered,
 (SELECT count(*) FROM (SELECT project_id, ordinal FROM desc_long GROUP BY 1,2 HAVING count(value)=0))
 + (SELECT count(*) FROM (SELECT ordinal FROM (SELECT * FROM pdesc_long UNION ALL {RISK_SURFACE}) GROUP BY 1 HAVING count(value)=0)) AS gaps)""", "desc_long", "pdesc_long"))
def r21(spark, sf):
    lines = shared_cells(spark, sf)
    proj = project_descriptors(project_facts(spark, sf, lines))
    port = portfolio_components(spark, sf, lines)
    cols = ["project_id", "surface", "metrics"]
    both = proj.select(*cols).unionByName(port.select(*cols))
    n = b.table(spark, sf, "nation").join(lines["time"].select("project").distinct(), C("n_name") == C("project")).agg(
        (F.count("*") * len(k.PROJECT_SURFACES) + len(k.PORTFOLIO_SURFACES)).alias("expected"))
    filled = F.size(F.filter(F.map_values("metrics"), lambda v: v.isNotNull()))
    got = both.agg(F.countDistinct("project_id", "surface").alias("n"), F.count_if(filled == 0).alias("gaps"))
    return got.join(n, how="cross").select(
        "expected", F.least("expected", "n").alias("covered"), F.least(F.lit(100.0), C("n") / C("expected") * 100).alias("coverage_pct"), "gaps")


# ----------------------------------------------------------------- risk report

_RISK_VALUES = ",".join(f"({i},'{r[0]}','{r[2]}','{m}',CAST({f} AS DOUBLE))" for i, r in enumerate(k.RISK_FAMILIES) for m, f in r[3].items())
b.define("risk_long", f"""SELECT id AS project_id, project AS project_name, period, ordinal, component_id, semantic_type, metric, value FROM facts,
 LATERAL (VALUES {_RISK_VALUES}) v(ordinal,component_id,semantic_type,metric,value) WHERE component_id<>'risk-data-quality' OR findings>0""", "facts")


def risk_descriptors(facts):
    """Nine risk families per selected project."""
    items = [F.struct(F.lit(i).alias("i"), F.lit(cid).alias("component_id"), F.lit(suffix).alias("suffix"), F.lit(sem).alias("semantic_type"),
                      _metrics(spec).alias("metrics")) for i, (cid, suffix, sem, spec) in enumerate(k.RISK_FAMILIES)]
    rows = facts.select(C("id").alias("project_id"), C("project").alias("project_name"), "period", _confidence().alias("confidence"),
                        C("findings").alias("_f"), F.inline(F.array(*items)))
    return rows.filter((C("component_id") != "risk-data-quality") | (C("_f") > 0)).select(
        "project_id", "project_name", "period", "confidence", (C("i") + 1000).alias("ordinal"), F.lit("risk").alias("surface"), "component_id",
        F.concat_ws(" - ", "project_name", "suffix").alias("component_name"), F.lit("chart").alias("kind"), "semantic_type", "metrics")


@query("r23_project_risk_descriptors", sql_with(
    "SELECT project_name, ordinal+1000 AS ordinal, 'risk' AS surface, component_id, semantic_type, metric, round(value,2) AS value FROM risk_long", "risk_long"))
def r23(spark, sf):
    return _long(risk_descriptors(project_facts(spark, sf)), "project_name")


# The same rules in SQL, over metrics pivoted to columns.
_PIVOT = {"ev": "ev", "ac": "ac", "cpi": "cpi", "cv": "cv", "profit": "profit", "margin": "margin", "periods": "periods", "slope": "slope",
          "r_squared": "r_squared", "forecast_next_net": "forecast_next_net", "last_net": "last_net", "max_residual_z": "max_residual_z",
          "row_count": "row_count", "bac": "bac", "etc": "etc", "remaining_budget": "remaining_budget", "total": "total", "top": "top",
          "accounting": "accounting", "reported": "reported", "budget": "budget", "actual": "actual", "variance": "variance",
          "severe": "severe", "warnings": "warnings", "latest_cash_in": "latest_cash_in", "latest_cash_out": "latest_cash_out",
          "negative_periods": "neg"}
b.define("risk_all", f"""SELECT 'portfolio' AS project_id, (SELECT max(month) FROM cost_lines) AS period, ordinal, component_id, semantic_type, metric, value, 0.9::DOUBLE AS confidence FROM ({RISK_SURFACE})
 UNION ALL SELECT r.project_id, r.period, ordinal+1000, component_id, semantic_type, metric, value, CASE WHEN m.regionkey=4 THEN 1.0 ELSE 0.86 END FROM risk_long r JOIN model m ON m.id=r.project_id""",
         "pdesc_long", "risk_long", "model", "cost_lines")
b.define("risk_wide", "SELECT project_id, period, ordinal, component_id, semantic_type, confidence, count(value) AS n_values, "
         + ", ".join(f"max(CASE WHEN metric='{m}' THEN value END) AS {a}" for m, a in _PIVOT.items())
         + ", max(CASE WHEN metric IN ('cumulative_cash_in','latest_cash_in') THEN value END) AS cin, max(CASE WHEN metric IN ('cumulative_cash_out','latest_cash_out') THEN value END) AS cout,"
         " max(CASE WHEN metric IN ('cumulative_net','latest_net') THEN value END) AS net FROM risk_all GROUP BY ALL", "risk_all")
PROFIT0 = "CASE WHEN profit IS NULL AND margin IS NULL THEN 'unavailable' WHEN profit<0 OR margin*100<0 THEN 'critical' WHEN margin IS NULL OR margin*100<0 THEN 'caution' ELSE 'favorable' END"
b.define("risk_eval", f"""SELECT *, CASE WHEN n_values=0 THEN 'unavailable' WHEN semantic_type IN ('cost_performance','cost_table') THEN {COST_RULE}
 WHEN semantic_type='profitability' THEN {PROFIT0} WHEN semantic_type IN ('cashflow','cumulative_cashflow') THEN {CASH_RULE}
 WHEN semantic_type='cashflow_trend' THEN {TREND_RULE} WHEN semantic_type='forecast' THEN {FC_RULE} WHEN semantic_type='concentration' THEN {CONC_RULE}
 WHEN semantic_type='reconciliation' THEN {REC_RULE} WHEN semantic_type='indirect_variance' THEN {IND_RULE}
 WHEN semantic_type='data_quality' THEN CASE WHEN severe>0 THEN 'critical' WHEN warnings>0 THEN 'caution' ELSE 'favorable' END ELSE 'informational' END AS status FROM risk_wide""", "risk_wide")
b.define("risk_first", """SELECT *, CASE WHEN status='mixed' THEN 'caution' ELSE status END AS severity, CASE WHEN status='unavailable' THEN 0.0::DOUBLE ELSE confidence END AS conf FROM
 (SELECT *, CASE semantic_type WHEN 'cost_table' THEN 'cost_performance' ELSE semantic_type END AS family FROM risk_eval)
 QUALIFY row_number() OVER (PARTITION BY project_id, family ORDER BY ordinal)=1""", "risk_eval")
b.define("risks", "SELECT * FROM risk_first WHERE severity IN ('critical','caution','unavailable')", "risk_first")


def evaluated_risks(spark, sf):
    lines = shared_cells(spark, sf)
    port = portfolio_components(spark, sf, lines).filter("surface = 'risk'")
    return op.evaluate(port.unionByName(risk_descriptors(project_facts(spark, sf, lines))))


@query("r24_risk_report", sql_with("""
SELECT project_id, family, component_id, period, conf AS confidence, status, severity,
 CASE WHEN project_id='portfolio' THEN 'portfolio' ELSE 'project' END AS scope FROM risks""", "risks"))
def r24(spark, sf):
    return op.risk_report(evaluated_risks(spark, sf)).drop("title")


@query("r25_risk_clusters", sql_with("""
SELECT family, count(*) FILTER (severity='critical') AS critical_count, count(*) FILTER (severity='caution') AS caution_count,
 count(*) FILTER (severity='unavailable') AS unavailable_count, count(*) AS assessments, count(DISTINCT project_id) AS projects, count(DISTINCT period) AS periods,
 coalesce(min(conf) FILTER (severity<>'unavailable'),min(conf),0) AS confidence_floor, count(DISTINCT severity) FILTER (severity<>'unavailable') AS decisions,
 CASE WHEN count(*) FILTER (severity='critical')>0 THEN 'critical' WHEN count(*) FILTER (severity='caution')>0 THEN 'caution' ELSE 'unavailable' END AS severity
FROM risks GROUP BY family""", "risks"))
def r25(spark, sf):
    return op.risk_clusters(op.risk_report(evaluated_risks(spark, sf)))


@query("r27_family_attention", sql_with("""
SELECT family, n, score, row_number() OVER (ORDER BY score DESC, family) AS ordinal FROM (SELECT family, count(*) AS n, 100*count(*) FILTER (status='critical')
 +10*count(*) FILTER (status='caution')+count(*) FILTER (status='unavailable') AS score FROM risk_first GROUP BY family)""", "risk_first"))
def r27(spark, sf):
    g = op.risk_assessments(evaluated_risks(spark, sf)).groupBy("family").agg(
        F.count("*").alias("n"), (F.count_if(C("status") == "critical") * 100 + F.count_if(C("status") == "caution") * 10
                                  + F.count_if(C("status") == "unavailable")).alias("score"))
    w = W.partitionBy().orderBy(F.desc("score"), "family")  # one row per family
    return g.withColumn("ordinal", F.row_number().over(w).cast("long"))


def filter_results(results, family=None, kind=None, status=None):
    """Results narrowed by family, kind and status; None keeps all."""
    for col, v in (("family", family), ("kind", kind), ("status", status)):
        if v is not None:
            results = results.filter(C(col) == v)
    return results


@query("r28_result_filter", sql_with(
    "SELECT project_id, component_id, status FROM risk_eval WHERE semantic_type='cashflow_trend' AND status='critical'", "risk_eval"))
def r28(spark, sf):
    res = evaluated_risks(spark, sf).withColumn("family", op.family_of("semantic_type"))
    return filter_results(res, family="cashflow_trend", status="critical").select("project_id", "component_id", "status")


def _title_sql(expr):
    return f"trim(regexp_replace(lower({expr}),'[^a-z0-9]+',' ','g'))"


def _quoted(v):
    return "'" + v.replace("'", "''") + "'"


b.define("components", "SELECT * FROM (VALUES " + ",".join(
    f"('{c[0]}','{c[1]}',{_quoted(dict(k.LINEAGE_ALIASES).get(c[1], c[2]))},{_quoted(c[2])})" for c in k.PROJECT_COMPONENTS) + ") v(surface,component_id,title,name)")
b.define("lineage_first", f"""SELECT *, {_title_sql('component')} AS title FROM lineage
 QUALIFY row_number() OVER (PARTITION BY project, {_title_sql('component')} ORDER BY ordinal)=1""", "lineage")


@query("r33_lineage_attachment", sql_with(f"""
SELECT m.name AS project_name, c.surface, c.component_id, l.status AS mapping_status, l.records AS source_records, CAST(l.locations AS BIGINT) AS locations,
 list_concat([m.name||'.xlsx · '||period, c.name||' · SHA-256 '||left(sha256(m.name||'|'||period),16)||'…'], list_concat(coalesce(e.evidence,[]::VARCHAR[]), coalesce(e.paths,[]::VARCHAR[]))) AS evidence,
 round(CASE WHEN l.confidence IS NOT NULL THEN least(CASE WHEN regionkey=4 THEN 1.0::DOUBLE ELSE 0.86::DOUBLE END,l.confidence)
  ELSE CASE WHEN regionkey=4 THEN 1.0::DOUBLE ELSE 0.86::DOUBLE END END,6) AS confidence
FROM model m CROSS JOIN components c LEFT JOIN lineage_first l ON l.project=m.name AND l.title={_title_sql('c.title')}
LEFT JOIN lineage_evidence e ON e.project=l.project AND e.ordinal IS NOT DISTINCT FROM l.ordinal""", "model", "components", "lineage_first", "lineage_evidence"))
def r33(spark, sf):
    lines = shared_cells(spark, sf)
    lineage = written(lineage_rows(spark, sf, lines, with_evidence=True), "lineage")  # read by the facts and attached below
    facts = project_facts(spark, sf, lines, lineage)
    aliases = inline_table(spark, k.LINEAGE_ALIASES, ["component_id", "alias"])
    digest = F.substring(F.sha2(F.concat_ws("|", "project_name", "period"), 256), 1, 16)
    own = F.array(F.concat("project_name", F.lit(".xlsx · "), "period"), F.concat("component_name", F.lit(" · SHA-256 "), digest, F.lit("…")))
    described = project_descriptors(facts).withColumn("source_evidence", own)
    out = op.attach_lineage(described, lineage, aliases)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("r35_risk_overview", sql_with("""
SELECT (SELECT (count(*)-count(*) FILTER (severity='unavailable'))/count(*)*100 FROM risk_first) AS coverage_pct,
 (SELECT count(*) FROM risks WHERE severity IN ('critical','caution')) AS adverse,
 (SELECT family FROM (SELECT family, count(*) FILTER (severity='critical') AS cr, count(*) FILTER (severity='caution') AS ca FROM risks GROUP BY 1)
  WHERE cr+ca>0 ORDER BY (cr=0)::INT, cr DESC, ca DESC, family LIMIT 1) AS top_cluster, (SELECT max(period) FROM risks) AS latest_period""", "risks"))
def r35(spark, sf):
    ev = cut(evaluated_risks(spark, sf))
    risks = op.risk_report(ev)
    return op.overview(risks, op.risk_counts(ev), op.risk_clusters(risks))
