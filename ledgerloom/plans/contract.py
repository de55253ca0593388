"""Output contract: which components exist, what they assess and which datasets feed them."""

from __future__ import annotations

# Project surfaces and portfolio views.
PROJECT_SURFACES = [
    "executive-overview", "executive-commercial", "executive-resources",
    "forecast-performance", "forecast-boq-actual", "forecast-boq-outlook",
    "structure-direct", "structure-indirect", "structure-allocation",
    "ledger-analytics", "ledger-transactions", "ledger-codes",
    "assurance-quality", "assurance-mapping", "assurance-workbooks", "assurance-visuals",
]
PORTFOLIO_SURFACES = ["charts", "analysis", "risk", "projects", "intelligence", "output"]

COST = {"budget": "budget", "ev": "ev", "ac": "ac", "cv": "cv", "cpi": "cpi"}

# Project components as (surface, id, name, kind, semantic type, {metric: fact}).
PROJECT_COMPONENTS = [
    ("executive-overview", "contract-price", "Contract Price", "kpi", "inventory", {"value": "contract"}),
    ("executive-overview", "total-budget-cost", "Total Budget Cost", "kpi", "inventory", {"value": "budget"}),
    ("executive-overview", "earned-value", "Earned Value", "kpi", "inventory", {"value": "ev"}),
    ("executive-overview", "actual-cost", "Actual Cost", "kpi", "inventory", {"value": "ac"}),
    ("executive-overview", "cost-variance", "Cost Variance", "kpi", "cost_performance", COST),
    ("executive-overview", "cpi", "CPI", "kpi", "cost_performance", COST),
    ("executive-overview", "direct-actual", "Direct Actual", "kpi", "inventory", {"value": "direct"}),
    ("executive-overview", "indirect-actual", "Indirect Actual", "kpi", "inventory", {"value": "indirect"}),
    ("executive-overview", "revenue", "Revenue", "kpi", "inventory", {"value": "revenue"}),
    ("executive-overview", "ledger-cost", "Ledger Cost", "kpi", "inventory", {"value": "ledger"}),
    ("executive-overview", "division-cost-position", "Budget vs Earned Value vs Actual Cost — by division", "chart", "cost_performance", COST),
    ("executive-overview", "cost-performance-map", "Cost Performance Map", "chart", "cost_table", {**COST, "row_count": "item_rows", "adverse_rows": "item_adverse"}),
    ("executive-commercial", "profitability", "Profitability — source methods kept separate", "chart", "profitability_methods", {"method_count": "method_count", "losses": "losses", "misses": "misses"}),
    ("executive-commercial", "monthly-cashflow", "Monthly Cashflow — Cash In vs Cash Out", "chart", "cashflow", {"periods": "cash_periods", "negative_periods": "cash_negative", "latest_cash_in": "last_cash_in", "latest_cash_out": "last_cash_out", "latest_net": "last_cash_net"}),
    ("executive-commercial", "cumulative-cashflow", "Cumulative Cashflow / S-Curve", "chart", "cumulative_cashflow", {"periods": "cash_periods", "cumulative_cash_in": "cum_in", "cumulative_cash_out": "cum_out", "cumulative_net": "cum_net"}),
    ("executive-commercial", "cashflow-trend", "Cashflow Trend Forecast", "chart", "cashflow_trend", {"periods": "cash_periods", "slope": "slope", "r_squared": "r_squared", "forecast_next_net": "forecast_next_net", "last_net": "last_net", "max_residual_z": "max_residual_z", "latest_cash_in": "cum_in", "latest_cash_out": "cum_out"}),
    ("executive-resources", "resource-pareto", "Direct Resource Cost Pareto", "chart", "concentration", {"row_count": "res_rows", "total": "res_total", "top": "res_top"}),
    ("executive-resources", "waste-efficiency", "Waste Efficiency", "chart", "waste", {"steel_actual": "steel_actual", "steel_budget": "steel_budget", "concrete_actual": "concrete_actual", "concrete_budget": "concrete_budget"}),
    ("executive-resources", "classification-bridge", "Accounting to Cost-Control Classification Bridge", "chart", "reconciliation", {"accounting": "bridge_accounting", "reported": "direct_kpi", "raw_direct": "raw_direct"}),
    ("forecast-performance", "wbs-performance", "Project Summary / WBS table", "table", "cost_table", {**COST, "row_count": "item_rows", "adverse_rows": "item_adverse"}),
    ("forecast-performance", "project-total-rows", "Project Summary group / total rows", "table", "inventory", {"row_count": "zero"}),
    ("forecast-boq-actual", "boq-resource-chart", "BOQ Resource Actual Cost chart", "chart", "concentration", {"row_count": "res_rows", "total": "res_total", "top": "res_top"}),
    ("forecast-boq-actual", "boq-resource-table", "Detailed BOQ Resource Explorer table", "table", "concentration", {"row_count": "res_rows", "total": "res_total", "top": "res_top"}),
    ("forecast-boq-outlook", "boq-forecast", "Detailed BOQ Forecast Analysis table", "table", "forecast", {"row_count": "fc_rows", "bac": "fc_bac", "ev": "fc_ev", "etc": "fc_etc", "remaining_budget": "fc_remaining"}),
    ("structure-direct", "direct-details", "Direct Details table", "table", "cost_table", {"row_count": "dd_rows", "budget": "dd_budget", "ev": "dd_ev", "ac": "dd_ac", "cv": "zero", "vac": "zero"}),
    ("structure-indirect", "indirect-details", "Indirect Cost Detail table", "table", "cost_table", {"row_count": "id_rows", "budget": "id_budget", "ev": "id_ev", "ac": "id_ac", "cv": "id_cv", "vac": "zero"}),
    ("structure-indirect", "indirect-pools", "Indirect Cost Pools table", "table", "cost_mix", {"row_count": "pool_rows", "total": "pool_total"}),
    ("structure-allocation", "direct-allocation", "Indirect-Direct Breakdown table", "table", "reconciliation", {"row_count": "alloc_rows", "actual": "alloc_actual", "equipment": "alloc_equipment", "other": "alloc_other"}),
    ("structure-allocation", "waste-report", "Waste Report table", "table", "waste", {"row_count": "waste_rows"}),
    ("structure-allocation", "waste-detail", "Waste Detail table", "table", "waste", {"row_count": "waste_rows"}),
    ("ledger-analytics", "ledger-trend", "Actual Expense Trend — source ledger", "chart", "ledger_trend", {"periods": "lm_periods", "latest": "lm_latest", "total": "lm_total"}),
    ("ledger-analytics", "expense-source-mix", "Expense Source Mix", "chart", "cost_mix", {"category_count": "src_count", "total": "lm_total"}),
    ("ledger-analytics", "top-cost-codes", "Top Cost Codes by Actual Ledger Cost", "chart", "concentration", {"row_count": "code_rows", "total": "code_total", "top": "code_top"}),
    ("ledger-analytics", "ledger-reconciliation", "Ledger Reconciliation", "chart", "reconciliation", {"accounting": "ledger", "reported": "ac_kpi", "raw_direct": "raw_direct", "raw_indirect": "raw_indirect"}),
    ("ledger-transactions", "expense-ledger", "Actual Expense Ledger table", "table", "ledger_trend", {"row_count": "exp_rows", "total": "lm_total"}),
    ("ledger-codes", "cost-code-register", "Cost Code Lookup table", "table", "inventory", {"row_count": "code_rows"}),
    ("assurance-quality", "data-quality", "Data Quality findings", "assurance", "data_quality", {"findings": "findings", "severe": "severe", "warnings": "warnings"}),
    ("assurance-quality", "source-lineage", "Source Lineage", "assurance", "inventory", {"sheets": "sheets", "tables": "tables", "charts": "zero", "cells": "cells"}),
    ("assurance-quality", "adaptive-coverage", "Adaptive Workbook Coverage", "assurance", "data_quality", {"sheets": "sheets", "tables": "tables", "charts": "zero", "cells": "cells", "unaccounted": "zero"}),
    ("assurance-mapping", "data-mapping", "Data Mapping", "table", "inventory", {"output_links": "links", "exact_evidence_links": "exact_links", "unavailable_links": "missing_links"}),
    ("assurance-workbooks", "workbook-sources", "Workbook Sources and Detected Tables", "assurance", "inventory", {"sheets": "sheets", "inventory_rows": "sheets", "snapshots": "zero", "tables": "tables", "cells": "cells"}),
    ("assurance-visuals", "source-visuals", "Workbook Charts and Source Media", "assurance", "inventory", {"chart_objects": "zero", "media_objects": "zero"}),
]

# Portfolio components as (surface, id, name, kind, semantic type, {metric: fact}).
CASH_METRICS = {"periods": "p_periods", "negative_periods": "p_negative", "latest_cash_in": "p_last_in", "latest_cash_out": "p_last_out", "latest_net": "p_last_net"}
REVISIONS = {"project_count": "p_registered", "revision_count": "p_revisions"}
PORTFOLIO_COMPONENTS = [
    ("charts", "portfolio-kpis", "Portfolio KPI cards — revenue-based profit method", "kpi", "cost_performance", {**COST, "revenue": "revenue", "profit": "gp", "margin": "margin", "project_count": "p_count"}),
    ("charts", "portfolio-position", "Portfolio Cost Position", "chart", "cost_performance", COST),
    ("charts", "portfolio-margin", "Revenue-based Margin vs Cost Performance", "chart", "profitability", {"profit": "gp", "margin": "margin", "cpi": "cpi"}),
    ("charts", "portfolio-mix", "Direct vs Indirect Actual Cost", "chart", "cost_mix", {"direct": "direct", "indirect": "indirect"}),
    ("charts", "portfolio-profit", "Revenue, Actual Cost & Revenue-based Gross Profit", "chart", "profitability", {"revenue": "revenue", "actual_cost": "ac", "profit": "gp", "margin": "margin"}),
    ("charts", "portfolio-cashflow", "Portfolio Cashflow Comparison", "chart", "cumulative_cashflow", {"periods": "p_periods", "cumulative_cash_in": "p_cum_in", "cumulative_cash_out": "p_cum_out", "cumulative_net": "p_cum_net"}),
    ("analysis", "portfolio-kpis", "Portfolio KPI cards — revenue-based profit method", "kpi", "cost_performance", {**COST, "revenue": "revenue", "profit": "gp", "margin": "margin", "project_count": "p_count"}),
    ("analysis", "technical-matrix", "CTO Technical Cost Matrix", "table", "cost_table", {**COST, "row_count": "p_count", "adverse_rows": "p_adverse"}),
    ("analysis", "monthly-comparison-chart", "CTO Monthly Cost Comparison chart", "chart", "cashflow", CASH_METRICS),
    ("analysis", "monthly-comparison-table", "CTO Monthly Cost Comparison table", "table", "cashflow", CASH_METRICS),
    ("analysis", "scenario-lab", "CTO Cost Scenario Lab", "scenario", "scenario", {"eac": "s_eac", "profit": "s_profit", "margin": "s_margin"}),
    ("projects", "project-registry-cards", "Project Registry cards", "table", "inventory", REVISIONS),
    ("intelligence", "monthly-history", "Validated Monthly / Revision History", "table", "inventory", REVISIONS),
    ("intelligence", "portfolio-data-quality", "Portfolio Data Quality", "assurance", "data_quality", {"findings": "p_findings", "severe": "p_severe", "warnings": "p_warnings"}),
    ("intelligence", "source-registry", "Source Registry", "table", "inventory", {"project_count": "p_registered"}),
    ("intelligence", "portfolio-data-mapping", "Portfolio Command Center Data Mapping", "table", "inventory", {"project_count": "p_registered"}),
    ("output", "output-studio", "Output Studio", "assurance", "inventory", {"report_types": "p_reports", **REVISIONS}),
]

# Per-project risk families as (id, name suffix, semantic type, {metric: fact}).
RISK_FAMILIES = [
    ("risk-cost-performance", "Cost Performance", "cost_performance", COST),
    ("risk-profitability", "Profitability", "profitability", {"profit": "base_gp", "margin": "base_margin", "method_count": "method_count"}),
    ("risk-cashflow", "Cumulative Cashflow", "cumulative_cashflow", {"periods": "cash_periods", "cumulative_cash_in": "cum_in", "cumulative_cash_out": "cum_out", "cumulative_net": "cum_net"}),
    ("risk-cash-trend", "Cashflow Trend", "cashflow_trend", {"periods": "cash_periods", "slope": "slope", "r_squared": "r_squared", "forecast_next_net": "forecast_next_net", "last_net": "last_net", "max_residual_z": "max_residual_z", "latest_cash_in": "cum_in", "latest_cash_out": "cum_out"}),
    ("risk-forecast", "Forecast Exposure", "forecast", {"row_count": "fc_rows", "bac": "fc_bac", "etc": "fc_etc", "remaining_budget": "fc_remaining"}),
    ("risk-concentration", "Cost Driver Concentration", "concentration", {"row_count": "res_rows", "total": "res_total", "top": "res_top"}),
    ("risk-reconciliation", "Cost Reconciliation", "reconciliation", {"accounting": "ledger", "reported": "ac_kpi"}),
    ("risk-indirect", "Indirect Cost Pressure", "indirect_variance", {"budget": "indirect_budget_kpi", "actual": "indirect_kpi", "variance": "indirect_variance"}),
    ("risk-data-quality", "Data Quality", "data_quality", {"findings": "findings", "severe": "severe", "warnings": "warnings"}),
]

# Component titles whose lineage is listed under another title.
LINEAGE_ALIASES = [
    ("division-cost-position", "Budget vs Earned Value vs Actual Cost by division"),
    ("profitability", "Profitability"),
    ("monthly-cashflow", "Monthly Cashflow Cash In vs Cash Out"),
    ("cumulative-cashflow", "Cumulative Cashflow S Curve"),
    ("resource-pareto", "Resource Cost Concentration"),
    ("waste-efficiency", "Waste and Material Efficiency"),
    ("classification-bridge", "Cost Classification Bridge"),
    ("wbs-performance", "Project Summary WBS"),
    ("project-total-rows", "Project Summary group total rows"),
    ("boq-resource-chart", "Detailed BOQ Resource Explorer"),
    ("boq-resource-table", "Detailed BOQ Resource Explorer"),
    ("boq-forecast", "Detailed BOQ Forecast Analysis"),
    ("direct-details", "Direct Details"),
    ("indirect-details", "Indirect Cost Detail"),
    ("indirect-pools", "Indirect cost pools granular vs official"),
    ("direct-allocation", "Indirect Direct Breakdown"),
    ("waste-report", "Waste Report"),
    ("ledger-trend", "Actual Expense Trend"),
    ("top-cost-codes", "Top Cost Codes"),
    ("expense-ledger", "Expense Transactions"),
    ("cost-code-register", "Cost Code Lookup"),
    ("data-quality", "Data Quality"),
]

# Project output bindings as (family, page, component, metric, datasets).
PROJECT_BINDINGS = [
    ("Executive", "Cost Position", "Contract Price", "contract_value", []),
    ("Executive", "Cost Position", "Total Budget Cost", "budget", []),
    ("Executive", "Cost Position", "Earned Value", "earned_value", ["project_items"]),
    ("Executive", "Cost Position", "Actual Cost", "actual_cost", ["project_items"]),
    ("Executive", "Cost Position", "Cost Variance", "cost_variance", ["project_items"]),
    ("Executive", "Cost Position", "CPI", "cpi", ["project_items"]),
    ("Executive", "Cost Position", "Direct Actual", "direct_cost", ["direct_details"]),
    ("Executive", "Cost Position", "Indirect Actual", "indirect_cost", ["indirect_details"]),
    ("Executive", "Cost Position", "Revenue", "revenue", ["profitability"]),
    ("Executive", "Cost Position", "Ledger Cost", None, ["ledger_months"]),
    ("Executive", "Cost Position", "Budget vs Earned Value vs Actual Cost — by division", None, ["project_items"]),
    ("Executive", "Cost Position", "Cost Performance Map", None, ["project_items"]),
    ("Executive", "Profit & Cashflow", "Profitability", None, ["profitability"]),
    ("Executive", "Profit & Cashflow", "Monthly Cashflow — Cash In vs Cash Out", None, ["cashflow"]),
    ("Executive", "Profit & Cashflow", "Cumulative Cashflow / S-Curve", None, ["cashflow"]),
    ("Executive", "Resources & Efficiency", "Resource Cost Concentration", None, ["boq_resources"]),
    ("Executive", "Resources & Efficiency", "Waste and Material Efficiency", None, ["waste", "waste_detail"]),
    ("Executive", "Resources & Efficiency", "Cost Classification Bridge", None, ["direct_alloc", "reallocation"]),
    ("Forecast Engineering", "WBS Performance", "Project Summary / WBS", None, ["project_items"]),
    ("Forecast Engineering", "WBS Performance", "Project Summary group / total rows", None, ["project_totals"]),
    ("Forecast Engineering", "BOQ Actual Costs", "Detailed BOQ Resource Explorer", None, ["boq_resources"]),
    ("Forecast Engineering", "BOQ Forecast", "Detailed BOQ Forecast Analysis", None, ["boq_forecasts"]),
    ("Cost Structure", "Direct Costs", "Direct Details", None, ["direct_details"]),
    ("Cost Structure", "Indirect Costs", "Indirect Cost Detail", None, ["indirect_details"]),
    ("Cost Structure", "Indirect Costs", "Indirect cost pools — granular vs official", None, ["indirect_granular", "indirect_official"]),
    ("Cost Structure", "Allocations & Waste", "Indirect-Direct Breakdown", None, ["direct_alloc", "reallocation"]),
    ("Cost Structure", "Allocations & Waste", "Waste Report", None, ["waste", "waste_detail"]),
    ("Ledger & Controls", "Ledger Analytics", "Actual Expense Trend", None, ["ledger_months"]),
    ("Ledger & Controls", "Ledger Analytics", "Expense Source Mix", None, ["ledger_aggregates"]),
    ("Ledger & Controls", "Ledger Analytics", "Top Cost Codes", None, ["ledger_aggregates"]),
    ("Ledger & Controls", "Ledger Analytics", "Ledger Reconciliation", None, ["cost_scope_reconciliation", "ledger_months"]),
    ("Ledger & Controls", "Transactions", "Expense Transactions", None, ["expenses_packed", "expense_months"]),
    ("Ledger & Controls", "Cost Code Register", "Cost Code Lookup", None, ["cost_codes"]),
    ("Source & Assurance", "Data Quality", "Data Quality", None, ["data_quality"]),
    ("Source & Assurance", "Data Quality", "Source Lineage", None, ["meta", "source_inventory"]),
    ("Source & Assurance", "Workbook Sources", "Workbook Sources and Detected Tables", None, ["source_inventory", "source_snapshots"]),
    ("Source & Assurance", "Source Visuals", "Workbook Charts and Source Media", None, ["source_charts", "source_media"]),
]

# Portfolio output bindings as (page, component, metric, datasets).
PORTFOLIO_BINDINGS = [
    ("Headline Position", "Selected Projects", None, []),
    ("Headline Position", "Contract Price", "contract_value", []),
    ("Headline Position", "Budget", "budget", []),
    ("Headline Position", "Earned Value", "earned_value", []),
    ("Headline Position", "Actual Cost", "actual_cost", []),
    ("Headline Position", "Portfolio CPI", None, ["project_items"]),
    ("Headline Position", "Cost Variance", "cost_variance", []),
    ("Headline Position", "Revenue", "revenue", []),
    ("Headline Position", "Gross Profit", "gross_profit", []),
    ("Headline Position", "Indirect Variance", None, ["indirect_details"]),
    ("Charts", "Portfolio Cost Position", None, ["project_items"]),
    ("Charts", "Margin vs Cost Performance", None, ["profitability", "project_items"]),
    ("Charts", "Direct vs Indirect Actual Cost", None, ["direct_details", "indirect_details"]),
    ("Charts", "Revenue, Actual Cost & Gross Profit", None, ["profitability", "project_items"]),
    ("Charts", "Portfolio Cashflow Comparison", None, ["cashflow"]),
    ("CTO Analysis", "CTO Technical Cost Matrix", None, ["project_items", "profitability"]),
    ("CTO Analysis", "CTO Monthly Cost Comparison", None, ["cashflow"]),
    ("CTO Analysis", "CTO Cost Scenario Lab", None, ["project_items", "profitability"]),
    ("Risk", "Portfolio Risk", None, ["project_items", "profitability", "cashflow", "cost_scope_reconciliation", "data_quality"]),
]
