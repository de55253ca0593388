"""Header aliases of the inferred sheet schemas."""

# Accepted header texts per canonical field.
DIRECT_SCHEMA = {
    "budget_pct": ["budget percentage", "budget %"],
    "main_area": ["main area", "project area"],
    "division_code": ["division code"],
    "division": ["division name", "division"],
    "item": ["extra discrpation", "extra description", "item name", "work item"],
    "main_code": ["main code (w.b.s)", "main code wbs", "main code", "wbs code"],
    "sub_code": ["sub code"],
    "boq_item": ["boq item", "boq no"],
    "description": ["item description", "description"],
    "unit": ["unit"],
    "budget_rate": ["budget rate", "budget rate l e"],
    "contract_rate": ["original contract rate", "contract rate"],
    "modified_contract_rate": ["modified contract rate", "modifed contract rate"],
    "contract_qty": ["contract quantity", "contract qty"],
    "final_qs_qty": ["final qs qty", "final qs quantity"],
    "invoice_pct": ["clinte invoice %", "client invoice %", "invoice %"],
    "invoice_qty": ["client invoice quantity", "invoice quantity"],
    "work_qty": ["work performed qty", "work performed quantity"],
    "contract_amount": ["contract amount"],
    "modified_contract_amount": ["modified contract amount", "modifed contract amount"],
    "original_budget": ["original budget"],
    "bac": ["bac"],
    "work_invoice_amount": ["work performed invoice amount", "internal invoice"],
    "invoice_amount": ["invoice amount"],
    "unbilled": ["unbilled amount", "unbilled"],
    "ev": ["bcwp ev", "earned value", "ev"],
    "ac": ["acwp actual cost", "actual cost", "ac"],
    "cv": ["cost variance", "cv"],
    "remaining_qty": ["remaining quantity", "remaining qty"],
    "etc": ["etc"],
    "eac": ["eac"],
    "vac": ["vac"],
}
DIRECT_TEXTS = {"budget_pct", "main_area", "division_code", "division", "item", "main_code", "sub_code", "boq_item", "description", "unit"}
DIRECT_NUMBERS = [f for f in DIRECT_SCHEMA if f not in DIRECT_TEXTS]
INDIRECT_SCHEMA = {
    "main_code": ["main code", "wbs code"],
    "serial": ["sr", "serial"],
    "description": ["item description", "description"],
    "unit": ["unit"],
    "forecast_monthly": ["forcast budget amount monthly", "forecast budget amount monthly"],
    "contract_duration": ["contract total duration", "contract duration"],
    "remaining_months": ["remaining month to complete project", "remaining months"],
    "original_budget": ["original budget"],
    "progress": ["project progress", "% project progress", "progress"],
    "ev": ["earned value", "ev"],
    "ac": ["actual cost", "ac"],
    "cv": ["cost variance", "cv"],
    "bac": ["bac"],
    "etc": ["etc"],
    "eac": ["eac"],
    "vac": ["vac"],
}
INDIRECT_TEXTS = {"main_code", "serial", "description", "unit", "forecast_monthly"}
INDIRECT_NUMBERS = [f for f in INDIRECT_SCHEMA if f not in INDIRECT_TEXTS]
LEDGER_SCHEMA = {
    "di": ["d i", "direct indirect"],
    "main_code": ["main code", "wbs code"],
    "resource_code": ["sub code", "resource code"],
    "entry_sheet": ["entry sheet"],
    "po": ["po material service", "po & material service", "po"],
    "source": ["source"],
    "posting_date": ["posting date"],
    "description": ["description"],
    "unit": ["unit"],
    "currency": ["currency"],
    "total_qty": ["total qy", "total qty", "total quantity"],
    "avg_unit_price": ["avg u p", "average unit price"],
    "currency_factor": ["currency factor"],
    "total_cost": ["total cost"],
    "item": ["item"],
}
BOQ_RESOURCE_SCHEMA = {
    "resource": ["sub package", "resource", "resource name"],
    "resource_code": ["resource code", "resource code."],
    "actual_cost": ["actual cost"],
    "work_qty": ["work performed qty", "work performed quantity"],
    "actual_rate": ["actual rate", "actual rate l e"],
    "eac": ["eac"],
}
BOQ_RESOURCE_REQUIRED = ["resource", "resource_code", "actual_cost", "work_qty"]
# Role -> (required fields, sheet-name hints, minimum fields, minimum score).
ROLES = {
    "direct_details": (DIRECT_SCHEMA, ["main_code", "description", "original_budget", "ev", "ac"], ["direct details"], 8, 70.0),
    "indirect_details": (INDIRECT_SCHEMA, ["main_code", "description", "original_budget", "ev", "ac"], ["indirect details"], 7, 70.0),
    "ledger": (LEDGER_SCHEMA, ["main_code", "source", "description", "currency"], ["expense", "ledger"], 6, 65.0),
}
# Row labels of the waste sheet.
WASTE_ROWS = {
    "actual": "الاستهلاك الفعلي",
    "engineering": "الاستهلاك الهندسي",
    "unit": "وحدة البند",
    "stock": "تشوين",
    "avg_price": "متوسط سعر",
}
# Spellings of the label of the quantity invoiced to the owner.
OWNER_QUANTITY = ["الكميه المدرجه", "الكمية المدرجة"]
# Headings of the groups of the reallocation sheet; a group owns three columns, the third holds the amount.
REALLOCATION_GROUPS = {"other_cost": "other costs", "equipment": "equipment"}
