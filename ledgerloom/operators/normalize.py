"""Normalised datasets derived from typed rows (after extraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import clean_text, norm_header, ratio, running_total, total_sum
from ledgerloom.session import cut


def project_items(direct: DataFrame) -> DataFrame:
    """Work-package items from direct-cost rows."""
    ev, ac, bac, eac = (F.col(c) for c in ("ev", "ac", "bac", "eac"))
    cv = F.coalesce("cv", ev - ac)
    vac = F.coalesce("vac", bac - eac)
    cpi = F.when(ac != 0, ev / ac).when((ev == 0) & (ac == 0), F.lit(1.0))
    done = F.when(F.col("final_qs_qty") != 0, F.col("work_qty") / F.col("final_qs_qty")).otherwise(F.col("invoice_pct"))

    def status(v):
        return F.when(v < 0, "Over budget").when(v.isNotNull(), "Under budget").otherwise("Unavailable")

    return direct.select(
        "project", "main_code", "division", F.col("description").alias("item"), "original_budget",
        "ev", "ac", cv.alias("cv"), status(cv).alias("status_to_date"), cpi.alias("cpi_to_date"),
        done.alias("completion"), "bac", "eac", "etc", vac.alias("vac"),
        status(vac).alias("forecast_status"), ratio("bac", "eac").alias("cpi_forecast"),
    )


def classify(ledger: DataFrame, direct_codes: DataFrame) -> DataFrame:
    """D when the code is a known direct code of the project or the raw flag is D, else I."""
    known = direct_codes.select("project", clean_text("main_code").alias("_code")).distinct().withColumn("_known", F.lit(True))
    j = ledger.withColumn("_code", clean_text("main_code")).join(known, ["project", "_code"], "left")
    di = F.when(F.col("_known") | (F.upper(F.trim("raw_di")) == "D"), "D").otherwise("I")
    return j.withColumn("di", di).drop("_code", "_known")


def ledger_by_month(totals: DataFrame) -> DataFrame:
    """Monthly ledger totals (project, month, total) on the ledger's own month list, 0 where a project has none."""
    sums = totals.filter(F.abs("total") > 0)
    spine = sums.select("month").distinct().join(sums.select("project").distinct(), how="cross")  # months x projects
    return spine.join(sums, ["project", "month"], "left").select("project", "month", F.coalesce("total", F.lit(0.0)).alias("total"))


def ledger_rollups(ledger: DataFrame) -> DataFrame:
    """Totals by code, by source (blank -> Unknown) and by class, as one long table."""
    source = F.when(clean_text("source") == "", "Unknown").otherwise(clean_text("source"))
    parts = F.array(
        F.struct(F.lit("code").alias("grouping"), clean_text("main_code").alias("name")),
        F.struct(F.lit("source").alias("grouping"), source.alias("name")),
        F.struct(F.lit("class").alias("grouping"), F.col("di").alias("name")),
        F.struct(F.lit("accounting").alias("grouping"), F.lit("all").alias("name")),
    )
    return (
        ledger.select("project", "total_cost", F.inline(parts))
        .groupBy("project", "grouping", "name")
        .agg(F.coalesce(total_sum("total_cost"), F.lit(0.0)).alias("value"))
    )


def apply_reallocation(alloc: DataFrame, realloc: DataFrame) -> DataFrame:
    """Attach reallocated amounts only to the first row of each code.

    The first row is found with an aggregate, not a window, so a hot code stays
    a map-side combine.
    """
    first = alloc.groupBy("project", "main_code").agg(F.min("resource").alias("_first"))
    j = alloc.join(first, ["project", "main_code"]).join(realloc, ["project", "main_code"], "left")
    on_first = F.col("resource") == F.col("_first")

    def amount(c):
        return F.when(on_first, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0)).alias(f"{c}_realloc")

    return j.select("project", "main_code", "resource", "actual_cost", amount("other_cost"), amount("equipment"))


def reallocation_totals(realloc: DataFrame) -> DataFrame:
    return realloc.groupBy("project").agg(
        F.coalesce(total_sum("other_cost"), F.lit(0.0)).alias("other_cost_total"),
        F.coalesce(total_sum("equipment"), F.lit(0.0)).alias("equipment_total"),
        F.countDistinct("main_code").alias("codes"),
    )


def forecast_register(direct: DataFrame, resources: DataFrame) -> DataFrame:
    """One row per direct item and one per resource; resource rows carry no budget."""
    null = F.lit(None).cast("double")
    base = direct.select(
        "project", "main_code", "division", F.lit("").alias("resource"), F.lit(False).alias("is_resource"),
        "ev", "bac", (F.col("bac") - F.col("ev")).alias("remaining_budget"),
        ratio("eac", "final_qs_qty").alias("forecast_rate"), "etc",
    )
    info = direct.groupBy("project", "main_code").agg(F.max_by(F.struct("division", "final_qs_qty"), "division").alias("d"))
    res = resources.join(info, ["project", "main_code"], "left").select(
        "project", "main_code", F.col("d.division").alias("division"), "resource", F.lit(True).alias("is_resource"),
        null.alias("ev"), null.alias("bac"), null.alias("remaining_budget"),
        F.when(F.col("eac").isNotNull() & (F.col("d.final_qs_qty") != 0), F.col("eac") / F.col("d.final_qs_qty"))
        .otherwise(ratio("actual_cost", "work_qty")).alias("forecast_rate"),
        (F.col("eac") - F.col("actual_cost")).alias("etc"),
    )
    return base.unionByName(res)


def waste_detail(waste: DataFrame) -> DataFrame:
    """Waste quantity and share: given, or from actual and engineering consumption."""
    qty = F.coalesce("given_qty", F.col("actual") - F.col("engineering"))
    pct = F.coalesce("given_pct", ratio(qty, F.col("engineering")))
    return waste.select(
        "project", "material", "actual", "engineering", qty.alias("waste_qty"), pct.alias("waste_pct"), "budget_pct",
        (pct - F.col("budget_pct")).alias("variance"), "avg_price", (qty * F.col("avg_price")).alias("waste_cost"),
    )


def repair_cash_out(flow: DataFrame, ledger_months: DataFrame) -> DataFrame:
    """Fill only formula-error cash-out cells from a non-zero same-month ledger total."""
    lm = ledger_months.select("project", "month", F.col("total").alias("ledger_total"))
    fix = (F.col("cash_out_state") == "formula_error") & (F.col("ledger_total") != 0)
    j = flow.join(lm, ["project", "month"], "left").select(
        "project", "month", "cash_in",
        F.when(fix, F.col("ledger_total")).otherwise(F.col("cash_out")).alias("cash_out"),
        F.when(fix, F.lit("same_month_transaction_ledger")).alias("cash_out_fallback"),
    )
    w = W.partitionBy("project").orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return j.select(
        "*",
        running_total(F.coalesce("cash_in", F.lit(0.0)), w).alias("cash_in_cum"),
        running_total(F.coalesce("cash_out", F.lit(0.0)), w).alias("cash_out_cum"),
    )


def budget_component(candidates: DataFrame, label: str, name: str) -> DataFrame:
    """First numeric budget candidate whose label equals the given one, per project."""
    hit = candidates.filter((norm_header("source_label") == label) & F.col("value").isNotNull())
    return hit.groupBy("project").agg(F.min_by("value", "rank").alias(name))


def kpi_block(metrics: DataFrame, direct: DataFrame, indirect: DataFrame, ledger_totals: DataFrame) -> DataFrame:
    """Headline KPIs per project from metrics and detail sums."""
    d = direct.groupBy("project").agg(total_sum("ac").alias("direct_sum"), total_sum("original_budget").alias("direct_budget_sum"))
    i = indirect.groupBy("project").agg(total_sum("ac").alias("indirect_sum"))
    j = metrics.join(d, "project", "left").join(i, "project", "left").join(ledger_totals, "project", "left")
    dsum = F.coalesce("direct_sum", F.lit(0.0))
    dbud = F.coalesce("direct_budget_sum", F.lit(0.0))
    budget = F.col("budget")
    no_budget = budget.isNull() | (budget == 0)
    direct_actual = F.when(
        (dsum != 0) & (F.col("direct_cost").isNull() | (F.col("direct_cost") == 0)), dsum
    ).otherwise(F.col("direct_cost"))
    return j.select(
        "project",
        F.col("contract_value").alias("contract_price_dashboard"),
        budget.alias("total_budget_cost"),
        F.coalesce("direct_budget_component", F.when(no_budget | (dbud <= budget * 1.05), dbud)).alias("direct_budget_cost"),
        F.coalesce(
            "indirect_budget_component", F.when((dbud != 0) & (budget >= dbud), budget - dbud)
        ).alias("indirect_budget_cost"),
        F.col("earned_value").alias("ev_dashboard_scope"),
        F.col("actual_cost").alias("actual_cost_dashboard_scope"),
        direct_actual.alias("direct_actual"),
        F.col("indirect_cost").alias("indirect_actual"),
        F.when(dsum != 0, dsum).alias("direct_detail_actual"),
        F.when(F.col("indirect_sum") != 0, F.col("indirect_sum")).alias("indirect_detail_actual"),
        F.col("revenue").alias("revenue_gross_profit"),
        ratio("earned_value", "actual_cost").alias("derived_cpi"),
        F.when(F.col("actual_cost") != 0, F.col("earned_value") - F.col("actual_cost")).alias("derived_cv"),
        "ledger_accounting_cost", "ledger_raw_direct", "ledger_raw_indirect",
    )


def detected_profitability(metrics: DataFrame) -> DataFrame:
    """One row per available method; margin is NULL without revenue."""
    return metrics.filter(F.col("gross_profit").isNotNull()).select(
        "project", F.lit("Detected Gross Profit").alias("method"), F.col("revenue").alias("base"),
        F.col("gross_profit").alias("profit"), ratio("gross_profit", "revenue").alias("profit_pct"),
    )


def scope_reconciliation(kpis: DataFrame) -> DataFrame:
    """Competing cost scopes side by side, never forced to agree."""
    d, i = F.col("direct_detail_actual"), F.col("indirect_detail_actual")
    return kpis.select(
        "project", F.col("actual_cost_dashboard_scope").alias("dashboard_actual"),
        d.alias("direct_detail_actual"), i.alias("indirect_detail_actual"),
        F.when(d.isNotNull() | i.isNotNull(), F.coalesce(d, F.lit(0.0)) + F.coalesce(i, F.lit(0.0))).alias("detail_total"),
        F.col("ledger_accounting_cost").alias("ledger_actual"), F.lit(False).alias("forced_reconciliation"),
    )


def learning_findings(learning: DataFrame) -> DataFrame:
    """info when the mapping confidence reaches 0.65, else warning."""
    return learning.select(
        "file", "role", "confidence",
        F.when(F.col("confidence") >= 0.65, "info").otherwise("warning").alias("severity"),
        F.concat(F.col("role"), F.lit(": "), F.coalesce("sheet", F.lit("not detected"))).alias("detail"),
    )


def month_list(ledger: DataFrame) -> DataFrame:
    """One row holding the ledger's sorted month names (bounded by the calendar)."""
    return ledger.select(F.explode("months.month").alias("m")).agg(F.sort_array(F.collect_set("m")).alias("names"))


def pack_ledger(ledger: DataFrame, names: DataFrame) -> DataFrame:
    """Sparse positional encoding: month index, quantity, unit price, total."""
    packed = F.transform(
        "months",
        lambda x: F.struct((F.array_position("names", x["month"]) - 1).cast("int").alias("idx"),
                           x["qty"].alias("qty"), x["unit_price"].alias("unit_price"), x["total"].alias("total")),
    )
    return ledger.join(names, how="cross").withColumn("packed", packed).drop("months", "names")


def unpack_ledger(packed: DataFrame, names: DataFrame) -> DataFrame:
    """Dense month list per transaction: months without an entry get total 0.

    Entries replace their months in a blank list, so the work follows the entries; a missing or repeated index is refused.
    """
    def entry(month, x, total):
        return F.struct(month.alias("month"), x["qty"].alias("qty"), x["unit_price"].alias("unit_price"), total.alias("total"))

    none = F.struct(F.lit(None).cast("double").alias("qty"), F.lit(None).cast("double").alias("unit_price"))
    blank = names.withColumn("_blank", F.transform("names", lambda m: entry(m, none, F.lit(0.0))))
    dense = F.aggregate(
        "packed", F.col("_blank"),
        lambda acc, x: F.concat(
            F.slice(acc, 1, x["idx"]),
            F.array(entry(F.element_at("names", x["idx"] + 1), x, F.coalesce(x["total"], F.lit(0.0)))),
            F.slice(acc, x["idx"] + 2, F.size("names"))),
    )
    placed = F.size(F.array_distinct(F.filter("packed.idx", lambda i: i.isNotNull()))) == F.size("packed")
    out = packed.join(blank, how="cross")
    months = F.when(placed, dense).otherwise(F.raise_error(F.lit("a ledger entry has no month or repeats one")))
    return out.withColumn("months", months).drop("_blank", "packed", "names")


def flatten_records(df: DataFrame, key: str, json: str) -> DataFrame:
    """Every array element found at any object nesting of a JSON document, one row each.

    One level of objects is opened at a time, from the written level before, until none is left.
    """
    level = df.select(key, F.parse_json(json).alias("v"))
    found = None
    while True:
        kind = F.schema_of_variant("v")
        arrays = level.filter(kind.startswith("ARRAY"))
        hits = arrays.lateralJoin(arrays.sparkSession.tvf.variant_explode(F.col("v").outer())).select(
            key, F.col("value").alias("record")
        )
        found = hits if found is None else found.unionByName(hits)
        objects = level.filter(kind.startswith("OBJECT"))
        if objects.isEmpty():
            return found
        level = cut(objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("v").outer())).select(
            key, F.col("value").alias("v")
        ))


def object_table(frames: list[DataFrame]) -> DataFrame:
    """Union of the keys of heterogeneous records; a missing key is NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
