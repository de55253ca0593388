"""Extraction of normalised datasets from sheet cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import cell_state, clean_text, codeish, excel_month, norm_header, running_total, total_sum
from ledgerloom.operators import banding
from ledgerloom.operators.cells import SHEET, band_of, header_rows, headers_by_schema, mapped_rows, number_of, provenance, schema_sheet
from ledgerloom.operators.schemas import BOQ_RESOURCE_REQUIRED, BOQ_RESOURCE_SCHEMA, DIRECT_NUMBERS, INDIRECT_NUMBERS, OWNER_QUANTITY, REALLOCATION_GROUPS, ROLES, WASTE_ROWS
from ledgerloom.session import written

C = F.col


def shown():
    """A cell as text, numbers included; whole numbers have no decimals."""
    whole = (C("value_num") == F.floor("value_num")) & (F.abs("value_num") < 1e15)
    return F.coalesce("value_str", F.when(whole, C("value_num").cast("long").cast("string")).otherwise(C("value_num").cast("string")))


def role_sheet(cells: DataFrame, role: str, heads: DataFrame | None = None) -> DataFrame:
    return schema_sheet(cells, *ROLES[role], heads)


def _description_ok():
    return ~F.coalesce(clean_text("description"), F.lit("")).startswith("#")


def direct_details(cells: DataFrame) -> DataFrame:
    rows = mapped_rows(cells, role_sheet(cells, "direct_details"), ["main_code", "description", "division", "boq_item", "unit", "item"], DIRECT_NUMBERS)
    return rows.filter(codeish("main_code") & _description_ok()).withColumn("evidence", provenance())


def indirect_details(cells: DataFrame) -> DataFrame:
    rows = mapped_rows(cells, role_sheet(cells, "indirect_details"), ["main_code", "description"], INDIRECT_NUMBERS)
    return rows.filter(codeish("main_code") & (clean_text("description") != "") & _description_ok()).withColumn("evidence", provenance())


def learning(cells: DataFrame) -> DataFrame:
    """Which sheet was learned for each role, per file; a role without a sheet has confidence 0."""
    files = cells.select("file").distinct()
    heads = headers_by_schema(cells, {role: spec[0] for role, spec in ROLES.items()})  # one pass over the cells for all roles
    out = None
    for role in ROLES:
        found = role_sheet(cells, role, heads.filter(C("schema") == role).drop("schema")).select("file", "sheet", C("confidence").alias("c"))
        one = files.join(found, "file", "left").select(
            "file", F.lit(role).alias("role"), "sheet", F.coalesce("c", F.lit(0.0)).alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


def cashflow(cells: DataFrame) -> DataFrame:
    """Month columns of the first sheet holding both cash labels, unpivoted with running sums."""
    label = norm_header("value_str")
    texts = cells.filter("value_str IS NOT NULL").select(*SHEET, "row", "col", label.alias("t"))
    is_in, is_out = C("t").rlike("cash ?in"), C("t").rlike("cash ?out")
    spots = texts.filter(is_in | is_out).groupBy(*SHEET).agg(
        F.max(F.when(is_in, F.struct("row", "col"))).alias("i"), F.max(F.when(is_out, C("row"))).alias("out_row"))
    spots = spots.filter("i IS NOT NULL AND out_row IS NOT NULL").groupBy("file").agg(
        F.min(F.struct("sheet_idx", "sheet", C("i.row").alias("in_row"), C("i.col").alias("label_col"), "out_row")).alias("s")).select("file", "s.*")
    near = cells.join(spots, SHEET)
    heads = near.filter((C("row") >= C("in_row") - 6) & (C("row") < C("in_row")) & (C("col") > C("label_col"))).select(
        *SHEET, "row", "col", excel_month(C("value_str"), C("value_num")).alias("month")).filter("month IS NOT NULL")
    header = heads.groupBy(*SHEET, "row").agg(F.count("*").alias("n")).filter("n >= 2").groupBy(*SHEET).agg(F.max("row").alias("row"))
    months = heads.join(header, [*SHEET, "row"]).groupBy(*SHEET, "month").agg(F.min("col").alias("col"))
    body = near.filter((C("row") == C("in_row")) | (C("row") == C("out_row"))).select(
        *SHEET, "col", (C("row") == C("in_row")).alias("is_in"), number_of().alias("n"), F.coalesce("value_str", C("value_num").cast("string")).alias("raw"))
    wide = body.groupBy(*SHEET, "col").agg(
        F.max(F.when(C("is_in"), C("n"))).alias("cash_in"), F.max(F.when(~C("is_in"), C("n"))).alias("cash_out"),
        F.max(F.when(C("is_in"), C("raw"))).alias("raw_in"), F.max(F.when(~C("is_in"), C("raw"))).alias("raw_out"))
    w = W.partitionBy("file").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    return months.join(wide, [*SHEET, "col"], "left").select(
        "file", "month", "cash_in", "cash_out",
        running_total(F.coalesce("cash_in", F.lit(0.0)), w).alias("cash_in_cum"), running_total(F.coalesce("cash_out", F.lit(0.0)), w).alias("cash_out_cum"),
        cell_state("raw_in").alias("cash_in_state"), cell_state("raw_out").alias("cash_out_state"))


def cost_codes(cells: DataFrame) -> DataFrame:
    """Side-by-side (code, description, type) triplets; a code's first occurrence wins.

    First means: earlier header, then earlier row. An aggregate finds it, so repeated codes
    need no ordered pass over the sheet.
    """
    heads = cells.filter("value_str IS NOT NULL").select(*SHEET, "row", "col", norm_header("value_str").alias("t"))
    triple = heads.filter(C("t").contains("code")).select(*SHEET, "row", "col")
    for off, word in ((1, "description"), (2, "type")):
        hit = heads.filter(C("t").contains(word)).select(*SHEET, "row", (C("col") - off).alias("col"))
        triple = triple.join(hit, [*SHEET, "row", "col"], "left_semi")
    counts = triple.groupBy(*SHEET).agg(F.count("*").alias("n")).groupBy("file").agg(
        F.min_by("sheet", F.struct((-C("n")).alias("n"), C("sheet_idx"))).alias("sheet"))
    bands = triple.join(counts, ["file", "sheet"]).select("file", "sheet", C("row").alias("header_row"), C("col").alias("band"))
    spots = bands.select("file", "sheet", "header_row", "band", F.inline(F.array(*[
        F.struct((C("band") + o).alias("col"), F.lit(n).alias("part")) for o, n in ((-1, "left"), (0, "code"), (1, "description"), (2, "type"))])))
    j = cells.select("file", "sheet", "row", "col", F.coalesce("value_str", C("value_num").cast("string")).alias("v")).join(
        spots, ["file", "sheet", "col"]).filter(C("row") > C("header_row"))
    rows = j.groupBy("file", "sheet", "header_row", "band", "row").agg(
        *[F.max(F.when(C("part") == p, C("v"))).alias(f"p_{p}") for p in ("left", "code", "description", "type")])
    code = F.when(codeish("p_code"), C("p_code")).when(codeish("p_left") & (C("band") > 1), C("p_left"))
    rec = F.struct("header_row", "band", "row", C("p_description").alias("description"), C("p_type").alias("account_type"))
    return rows.select("file", "sheet", clean_text(code).alias("code"), "header_row", "band", "row", "p_description", "p_type").filter(
        codeish("code")).groupBy("file", "sheet", "code").agg(F.min(rec).alias("r")).select("file", "code", "r.description", "r.account_type", "r.row")


def ledger(cells: DataFrame) -> DataFrame:
    """Ledger rows with their sparse monthly entries from (qty, price, total) month triplets; who needs only their number reads ``n_months``."""
    chosen = role_sheet(cells, "ledger")
    text = ["di", "main_code", "resource_code", "source", "description", "currency"]
    rows = mapped_rows(cells, chosen, text, ["total_qty", "avg_unit_price", "currency_factor", "total_cost"]).filter(codeish("main_code"))
    rows = rows.filter(C("row") > C("header_row") + 1)
    heads = cells.join(chosen.select("file", "sheet", "header_row"), ["file", "sheet"]).filter(
        (C("row") == C("header_row")) | (C("row") == C("header_row") + 1))
    # Two rows of each sheet: written, so that the joins of the cells with what they say broadcast it.
    heads = written(heads.select("file", "sheet", "row", "col", "value_str", "value_num", "header_row"), "ledger-heads")
    item_cols = heads.filter((C("row") == C("header_row")) & norm_header("value_str").startswith("item")).select("file", "sheet", "col")
    shown = F.coalesce("value_str", C("value_num").cast("string"))
    items = cells.select("file", "sheet", "row", "col", shown.alias("v")).join(item_cols, ["file", "sheet", "col"]).filter(
        clean_text("v") != "").groupBy("file", "sheet", "row").agg(F.max_by("v", "col").alias("item"))
    month = heads.filter(C("row") == C("header_row")).select(
        "file", "sheet", "col", excel_month(C("value_str"), C("value_num")).alias("month")).filter("month IS NOT NULL")
    sub = heads.filter(C("row") > C("header_row")).select("file", "sheet", "col", norm_header("value_str").alias("sub"))
    cols = month.join(sub, ["file", "sheet", "col"], "left").filter(
        C("sub").isNull() | C("sub").isin("qy", "qty", "quantity", "")).groupBy("file", "sheet", "month").agg(F.min("col").alias("c"))
    spots = cols.select("file", "sheet", "month", F.inline(F.array(*[
        F.struct((C("c") + o).alias("col"), F.lit(p).alias("part")) for o, p in ((0, "qty"), (1, "price"), (2, "total"))])))
    spots = written(spots, "ledger-months")
    # The cells of a row meet once: its months, its entries and the join with the row are then made where they are.
    entry = cells.select("file", "sheet", "row", "col", number_of().alias("n")).join(F.broadcast(spots), ["file", "sheet", "col"]).select("file", "sheet", "row", "month", "part", "n")
    entry = entry.repartition("file", "sheet", "row").groupBy("file", "sheet", "row", "month").agg(*[F.max(F.when(C("part") == p, C("n"))).alias(p) for p in ("qty", "price", "total")])
    kept = entry.filter(F.abs("total") > 0).groupBy("file", "sheet", "row").agg(
        F.sort_array(F.collect_list(F.struct("month", "qty", C("price").alias("unit_price"), "total"))).alias("months"),
        total_sum("total").alias("month_total"))
    j = rows.join(kept, ["file", "sheet", "row"], "left").join(items, ["file", "sheet", "row"], "left")
    out = j.select(
        "file", "sheet", "row", clean_text("main_code").alias("main_code"), "resource_code", F.upper(clean_text("di")).alias("raw_di"), "source",
        F.coalesce("item", "source").alias("item"), "description", "months", F.size("months").cast("long").alias("n_months"),
        F.coalesce("total_cost", "month_total", F.lit(0.0)).alias("total_cost"), "total_qty")
    out = written(out, "ledger-rows", source=cells)  # numbering counts the bands before it reads the rows
    return banding.row_number(out, ["file", "sheet"], band_of(), ["row"], "sn")


def indirect_pools(cells: DataFrame) -> DataFrame:
    """Up to two disjoint label/cost bands with three or more rows: left is granular, right official."""
    heads = cells.filter(C("col") >= 2).filter(norm_header("value_str") == "cost").select(
        *SHEET, C("row").alias("header_row"), C("col").alias("cost_col"))
    named = cells.filter("value_str IS NOT NULL").groupBy(*SHEET).agg(
        F.bool_or(norm_header("value_str").contains("total indirect cost")).alias("blob"))
    ok = named.filter(C("blob") | norm_header("sheet").contains("indirect")).select(*SHEET)
    heads = heads.join(ok, SHEET, "left_semi")
    spots = heads.select(*SHEET, "header_row", "cost_col", F.inline(F.array(
        F.struct((C("cost_col") - 1).alias("col"), F.lit("label").alias("part")), F.struct(C("cost_col").alias("col"), F.lit("cost").alias("part")))))
    rows = cells.join(spots, [*SHEET, "col"]).filter(C("row") > C("header_row")).groupBy(*SHEET, "header_row", "cost_col", "row").agg(
        F.max(F.when(C("part") == "label", C("value_str"))).alias("category"), F.max(F.when(C("part") == "cost", number_of())).alias("cost"))
    t = norm_header("category")
    rows = rows.filter((t != "") & C("cost").isNotNull() & ~t.contains("total") & ~t.contains("reallocated"))
    band = rows.groupBy(*SHEET, "header_row", "cost_col").agg(F.count("*").alias("n")).filter("n >= 3")
    # A handful of bands per sheet: take them greedily, best first, while their columns are free.
    ranked = band.groupBy(*SHEET).agg(F.sort_array(F.collect_list(F.struct("n", "header_row", "cost_col")), asc=False).alias("b"))
    init = F.array().cast("array<struct<n:bigint,header_row:int,cost_col:int>>")
    picked = F.aggregate("b", init, lambda acc, x: F.when(
        (F.size(acc) < 2) & ~F.exists(acc, lambda y: F.abs(y["cost_col"] - x["cost_col"]) <= 1),
        F.concat(acc, F.array(F.struct(x["n"].cast("bigint").alias("n"), x["header_row"].cast("int").alias("header_row"), x["cost_col"].cast("int").alias("cost_col"))))).otherwise(acc))
    total = F.aggregate(F.slice("b", 1, 2), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    best = ranked.select(*SHEET, picked.alias("p"), total.alias("total")).groupBy("file").agg(
        F.min_by(F.struct("sheet", "sheet_idx", "p"), F.struct((-C("total")).alias("t"), C("sheet_idx"))).alias("s")).select("file", "s.*")
    chosen = best.select("file", "sheet", "sheet_idx", F.posexplode(F.array_sort(F.transform("p", lambda x: F.struct(x["cost_col"].alias("cost_col"), x["header_row"].alias("header_row"))))).alias("side", "q"))
    chosen = chosen.select(*SHEET, C("q.header_row").alias("header_row"), C("q.cost_col").alias("cost_col"),
                           F.when(C("side") == 0, "granular").otherwise("official").alias("classification"))
    out = rows.withColumn("header_row", C("header_row").cast("int")).withColumn("cost_col", C("cost_col").cast("int")).join(
        chosen, [*SHEET, "header_row", "cost_col"])
    return out.filter(~norm_header("category").isin("category", "cost")).select("file", "category", "cost", "classification")


def direct_allocation(cells: DataFrame) -> DataFrame:
    """Resource rows under their work code: code and item are filled down the sheet."""
    texts = cells.filter(C("value_str").isNotNull()).select(*SHEET, "row", "col", norm_header("value_str").alias("t"))
    heads = texts.filter(C("t").isin("resource", "actual cost")).groupBy(*SHEET, "row").agg(
        F.max(F.when(C("t") == "resource", C("col"))).alias("rcol"), F.max(F.when(C("t") == "actual cost", C("col"))).alias("acol")).filter(
        "rcol IS NOT NULL AND acol IS NOT NULL")
    first = heads.groupBy("file").agg(F.min(F.struct("sheet_idx", "row", "sheet", "rcol", "acol")).alias("h")).select(
        "file", "h.sheet", "h.sheet_idx", C("h.row").alias("header_row"), "h.rcol", "h.acol")
    body = cells.join(first, SHEET).filter(C("row") > C("header_row"))
    is_code = C("col").between(C("rcol") - 4, C("rcol") - 1) & codeish("value_str")
    label = (C("col") < C("rcol")) & C("value_str").isNotNull() & ~codeish("value_str") & ~C("value_str").startswith("#")
    rows = body.groupBy(*SHEET, "row").agg(
        F.min_by(clean_text("value_str"), F.when(is_code, C("col"))).alias("code_here"), F.max_by("value_str", F.when(label, C("col"))).alias("item_here"),
        F.max(F.when(C("col") == C("rcol"), C("value_str"))).alias("resource"), F.max(F.when(C("col") == C("acol"), number_of())).alias("actual_cost"))
    rows = rows.withColumn("head", F.when(C("code_here").isNotNull(), F.struct(C("code_here").alias("code"), C("item_here").alias("item"))))
    filled = banding.forward_fill(rows, SHEET, band_of(), ["row"], "head", "cur")
    return filled.filter(C("cur").isNotNull() & (clean_text("resource") != "") & ~C("resource").startswith("#") & C("actual_cost").isNotNull()).select(
        "file", "row", C("cur.code").alias("main_code"), C("cur.item").alias("item"), "resource", "actual_cost")


def reallocation(cells: DataFrame, header_rows: int = 8, code_cols: int = 8) -> DataFrame:
    """Reallocated amounts per code: (file, sheet, main_code, other_cost, equipment), from the first sheet with a group heading.

    A heading in the first rows owns three columns, the third holds the amount; of repeated headings the last one counts, and a heading whose
    block leaves the sheet is none. A row's code is its first code-like cell; of rows with one code the last one counts. A group that the
    sheet hasn't got is NULL, an amount that isn't a number is 0.
    """
    found = cells.groupBy(*SHEET).agg(F.count_if(codeish(shown())).alias("codes"), F.max("col").alias("max_col"))
    heads = cells.filter((C("row") <= header_rows) & C("value_str").isNotNull()).join(found.filter("codes >= 2"), SHEET).filter("col + 2 <= max_col")
    t = norm_header("value_str")
    last = [F.max_by(C("col") + 2, F.when(t == text, F.struct("row", "col"))).alias(f"{name}_col") for name, text in REALLOCATION_GROUPS.items()]
    groups = heads.filter(t.isin(list(REALLOCATION_GROUPS.values()))).groupBy(*SHEET).agg(*last)
    names = [f"{name}_col" for name in REALLOCATION_GROUPS]
    chosen = groups.groupBy("file").agg(F.min_by(F.struct("sheet", *names), "sheet_idx").alias("g")).select("file", "g.*")
    body = cells.join(chosen, ["file", "sheet"])
    rows = body.groupBy("file", "sheet", "row", *names).agg(
        F.min_by(clean_text(shown()), F.when((C("col") <= code_cols) & codeish(shown()), C("col"))).alias("main_code"),
        *[F.max(F.when(C("col") == C(c), number_of())).alias(c.removesuffix("_col")) for c in names])
    amount = [F.when(C(c).isNotNull(), F.coalesce(c.removesuffix("_col"), F.lit(0.0))).alias(c.removesuffix("_col")) for c in names]
    coded = rows.filter("main_code IS NOT NULL").select("file", "sheet", "main_code", F.struct("row", *amount).alias("r"))
    return coded.groupBy("file", "sheet", "main_code").agg(F.max("r").alias("r")).select("file", "sheet", "main_code", *(f"r.{n}" for n in REALLOCATION_GROUPS))


def reallocated_allocation(cells: DataFrame) -> DataFrame:
    """Direct allocation with the reallocated amounts on the first row of each code."""
    rows = direct_allocation(cells)
    first = rows.groupBy("file", "main_code").agg(F.min("row").alias("row"))
    amounts = first.join(reallocation(cells).drop("sheet"), ["file", "main_code"])
    return rows.join(amounts, ["file", "main_code", "row"], "left").select(
        *rows.columns, *(F.coalesce(n, F.lit(0.0)).alias(f"{n}_realloc") for n in REALLOCATION_GROUPS))


def boq_resources(cells: DataFrame, direct: DataFrame, code_rows: int = 8, code_cols: int = 10) -> DataFrame:
    """Resource rows of every sheet that carries the resource schema and names a verified code.

    A sheet belongs to the earliest cell, row by row, above or right below its header whose text is a code of ``direct`` (file, main_code,
    description, unit, row: of rows with one code the last one describes it). Cells of the first ``code_rows`` rows and ``code_cols`` columns go
    before all others; without a code there, the sheet belongs to the earliest one further down or right. A sheet without any gives no rows.
    """
    heads = header_rows(cells, BOQ_RESOURCE_SCHEMA)
    need = F.array(*map(F.lit, BOQ_RESOURCE_REQUIRED))
    field = F.map_from_arrays("cols", "fields")
    learned = heads.filter(F.size(F.array_except(need, "fields")) == 0).select(
        *SHEET, "header_row", field.alias("field"), F.map_from_arrays("fields", "cols")["resource"].alias("resource_col"), F.array_contains("fields", "actual_rate").alias("has_rate"),
        F.round(F.least(F.lit(1.0), F.size("fields") / F.lit(len(BOQ_RESOURCE_SCHEMA))), 3).alias("confidence"))
    known = direct.withColumn("main_code", clean_text("main_code")).filter("main_code <> ''").groupBy("file", "main_code").agg(
        F.max_by(F.struct("description", "unit"), "row").alias("d"))
    places = cells.join(learned.select(*SHEET, "header_row"), SHEET).filter("row <= header_row + 1")
    codes = places.withColumn("main_code", clean_text(shown())).join(known, ["file", "main_code"]).groupBy(*SHEET).agg(
        F.min_by(F.struct("main_code", "d"), F.struct((C("row") > code_rows) | (C("col") > code_cols), "row", "col")).alias("c"))
    sheets = learned.join(codes, SHEET).select(*SHEET, "header_row", "field", "resource_col", "has_rate", "confidence", "c.main_code", "c.d.description", "c.d.unit")
    keys = ["header_row", "resource_col", "has_rate", "confidence", "main_code", "description", "unit"]
    f = F.try_element_at("field", C("col").cast("long"))
    body = cells.join(sheets, SHEET).filter("row > header_row").select(*SHEET, "row", "col", *keys, "value_str", shown().alias("text"), number_of().alias("n"), f.alias("f"))
    rows = body.groupBy(*SHEET, "row", *keys).agg(
        F.max(F.when(C("f") == "resource", C("value_str"))).alias("resource"), F.max(F.when(C("f") == "resource_code", C("text"))).alias("resource_code"),
        F.min_by("n", F.when((C("col") < C("resource_col")) & C("n").isNotNull(), C("col"))).alias("no"),
        *[F.max(F.when(C("f") == x, C("n"))).alias(x) for x in ("actual_cost", "work_qty", "actual_rate", "eac")])
    rows = rows.filter((clean_text("resource") != "") & ~C("resource").startswith("#") & C("actual_cost").isNotNull())
    rate = F.when(C("has_rate"), C("actual_rate")).when(C("work_qty") != 0, C("actual_cost") / C("work_qty"))
    described = F.when(clean_text("description") != "", C("description")).otherwise(C("sheet"))
    return rows.select("file", "sheet", "row", "main_code", described.alias("description"), "unit", "no", "resource", "resource_code", "actual_cost", "work_qty",
                       rate.alias("actual_rate"), "eac", provenance().alias("evidence"))


def waste_kind(label: str = "value_str"):
    """What a label of the waste sheet's first column measures, NULL for any other text."""
    t = norm_header(label)
    kind = (
        F.when(t.contains("actual waste quantity"), "waste_qty").when(t.contains("actual waste") & clean_text(label).contains("%"), "waste_pct")
        .when(t.contains("budget waste"), "budget_waste_pct").when(t.contains("waste variance"), "waste_variance"))
    for name, word in WASTE_ROWS.items():
        kind = F.coalesce(kind, F.when(t.contains(word), name))
    owner = t.contains(OWNER_QUANTITY[0]) | t.contains(OWNER_QUANTITY[1])
    return F.coalesce(kind, F.when(owner, "owner_qty"), F.when(t.contains("total actual cost") & t.contains("waste"), "waste_cost"))


def _waste_labels(cells: DataFrame) -> DataFrame:
    """Metric rows of the sheets with five or more kinds: the last row of each kind, of waste cost the first."""
    labels = cells.filter((C("col") == 1) & C("value_str").isNotNull()).select(*SHEET, "row", C("value_str").alias("label"), waste_kind().alias("kind")).filter("kind IS NOT NULL")
    row = F.when(C("kind") == "waste_cost", -C("row")).otherwise(C("row"))
    rows = labels.groupBy(*SHEET, "kind").agg(F.max_by(F.struct("row", "label"), row).alias("r")).select(*SHEET, "kind", "r.*")
    enough = rows.groupBy(*SHEET).agg(F.count("*").alias("k")).filter("k >= 5").select(*SHEET)
    return rows.join(enough, SHEET, "left_semi")


def _material_bands(cells: DataFrame) -> DataFrame:
    """First column of concrete and the heading row, where both headings were seen and concrete stands right of steel."""
    heads = cells.filter((C("col") >= 2) & C("value_str").isNotNull()).select(*SHEET, "row", "col", norm_header("value_str").alias("t"))
    steel, concrete = C("t").contains("steel"), C("t").contains("concrete")
    heads = heads.filter(steel | concrete)
    until = heads.groupBy(*SHEET).agg(F.min(F.when(steel, C("row"))).alias("s"), F.min(F.when(concrete, C("row"))).alias("c")).filter("s IS NOT NULL AND c IS NOT NULL").select(
        *SHEET, F.greatest("s", "c").alias("heading_row"))
    at = F.struct("row", "col")
    return heads.join(until, SHEET).filter("row <= heading_row").groupBy(*SHEET, "heading_row").agg(
        F.max(F.when(steel, at))["col"].alias("steel"), F.max(F.when(concrete, at))["col"].alias("split")).filter("split > steel").select(*SHEET, "heading_row", "split")


def waste_summary(cells: DataFrame) -> DataFrame:
    """Metric rows by steel and concrete column bands: % rows are averaged, others summed.

    Without explicit material headers, or with the concrete band not to the right, nothing is returned.
    """
    rows = _waste_labels(cells).join(_material_bands(cells), SHEET)
    v = cells.filter(C("col") >= 2).select(*SHEET, "row", "col", number_of().alias("n")).join(rows, [*SHEET, "row"])
    steel, conc = F.when(C("col") < C("split"), C("n")), F.when(C("col") >= C("split"), C("n"))
    pct = C("label").contains("%")
    g = v.groupBy(*SHEET, "row", "label", "kind").agg(
        total_sum(steel).alias("s"), F.count(steel).alias("sn"), total_sum(conc).alias("c"), F.count(conc).alias("cn"))

    def val(total, n):
        return F.when(pct & (C(n) > 0), C(total) / C(n)).otherwise(F.coalesce(total, F.lit(0.0)))

    return g.select("file", "kind", "label", val("s", "sn").alias("steel"), val("c", "cn").alias("concrete"))


WASTE_NUMBERS = ["actual", "engineering", "stock", "owner_qty", "waste_qty", "waste_pct", "budget_waste_pct", "waste_variance", "avg_price", "waste_cost"]


def waste_detail(cells: DataFrame) -> DataFrame:
    """One record per material column of the first waste sheet of a file: the sheet's rows are the fields.

    Quantity and share of waste are the sheet's own where it has such a row, else they come from actual and engineering consumption. The item
    stands above the actual consumption. Columns without item and consumption are left out; without both material headings nothing is returned.
    """
    labels = _waste_labels(cells)
    first = labels.groupBy("file").agg(F.min_by("sheet", "sheet_idx").alias("sheet"), F.min("sheet_idx").alias("sheet_idx"))
    mine = labels.join(first, SHEET, "left_semi")
    given = mine.groupBy(*SHEET).agg(F.collect_set("kind").alias("kinds"), F.greatest(F.lit(1), F.coalesce(F.max(F.when(C("kind") == "actual", C("row"))), F.lit(0)) - 1).alias("item_row"))
    sheets = given.join(_material_bands(cells), SHEET)
    roles = mine.select(*SHEET, "row", "kind").unionByName(given.select(*SHEET, C("item_row").alias("row"), F.lit("item").alias("kind")))
    values = cells.filter(C("col") >= 2).select(*SHEET, "row", "col", shown().alias("text"), number_of().alias("n")).join(roles, [*SHEET, "row"])
    wide = values.groupBy(*SHEET, "col").agg(
        *[F.max(F.when(C("kind") == k, C("text"))).alias(k) for k in ("item", "unit")], *[F.max(F.when(C("kind") == k, C("n"))).alias(f"s_{k}") for k in WASTE_NUMBERS])
    j = wide.join(sheets, SHEET).filter((clean_text("item") != "") | C("s_actual").isNotNull() | C("s_engineering").isNotNull())

    def own(kind: str, other):
        return F.when(F.array_contains("kinds", kind), C(f"s_{kind}")).otherwise(other)

    qty = own("waste_qty", C("s_actual") - C("s_engineering"))
    pct = own("waste_pct", F.when(C("s_engineering") != 0, qty / C("s_engineering")))
    plain = {k: C(f"s_{k}") for k in WASTE_NUMBERS} | {"waste_qty": qty, "waste_pct": pct}
    return j.select("file", "sheet", "col", F.when(C("col") < C("split"), "Steel").otherwise("Concrete").alias("type"), "item", "unit", *(plain[k].alias(k) for k in WASTE_NUMBERS),
                    F.struct(C("sheet").alias("source_sheet"), C("item_row").alias("source_row"), C("heading_row").alias("source_header_row"), F.lit(0.95).alias("mapping_confidence")).alias("evidence"))


def project_totals(cells: DataFrame) -> DataFrame:
    """Total, indirect and fee rows of the first sheet with division and description headers."""
    t = norm_header("value_str")
    texts = cells.filter("value_str IS NOT NULL").select(*SHEET, "row", t.alias("t"))
    sheets = texts.groupBy(*SHEET).agg(
        F.bool_or(C("t").contains("division name")).alias("d"), F.bool_or(C("t").contains("item description")).alias("i")).filter("d AND i")
    first = sheets.groupBy("file").agg(F.min(F.struct("sheet_idx", "sheet")).alias("s")).select("file", "s.*")
    rows = cells.join(first, SHEET).groupBy(*SHEET, "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(C("value_str").isNotNull(), F.struct("col", t.alias("t"))))), lambda x: x["t"]), " ").alias("text"),
        F.count_if(C("value_num").isNotNull()).alias("numbers"), total_sum("value_num").alias("total"))
    x = C("text")
    hit = x.contains("total") | x.contains("indirect") | x.contains("fees") | (x.contains("works") & (C("numbers") > 0))
    return rows.filter(hit & ~x.contains("under budget") & ~x.contains("over budget")).select("file", "row", "text", "numbers", "total")


