"""Workbook cells derived from the given tables: one file per project plus a code register.

Each sheet is laid out from grouped lines by arithmetic on the keys, so no pass over a
whole sheet is needed to place its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import line_sum, total_sum
from ledgerloom.operators.schemas import OWNER_QUANTITY, WASTE_ROWS
from ledgerloom.plans import bindings as b
from ledgerloom.session import removed, written

C = F.col
CELL_COLUMNS = ["file", "sheet", "sheet_idx", "row", "col", "value_str", "value_num", "formula"]


def code_number(c: str = "main_code") -> Column:
    return F.regexp_extract(c, r"(\d+)$", 1).cast("long")


def text_rank(c: str) -> Column:
    """Small number that differs between the category names."""
    return F.ascii(c) + F.ascii(F.substring(c, 2, 1))


def _cell(col: int, value: Column | str | None, number: bool = False) -> Column:
    v = F.lit(value) if isinstance(value, str) or value is None else value
    return F.struct(
        F.lit(col).cast("long").alias("col"), (F.lit(None) if number else v).cast("string").alias("value_str"),
        (v if number else F.lit(None)).cast("double").alias("value_num"))


def sheet(rows: DataFrame, file: Column, name: str, idx: int, row: Column, cells: list[Column]) -> DataFrame:
    placed = rows.select(file.alias("file"), row.cast("long").alias("row"), F.inline(F.array(*cells)))
    return placed.filter("value_str IS NOT NULL OR value_num IS NOT NULL").select(
        "file", F.lit(name).alias("sheet"), F.lit(idx).alias("sheet_idx"), "row", "col", "value_str", "value_num",
        F.lit(None).cast("string").alias("formula"))


def header(files: DataFrame, name: str, idx: int, row: int, titles: dict[int, str]) -> DataFrame:
    return sheet(files, C("project"), name, idx, F.lit(row), [_cell(c, t) for c, t in titles.items()])


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, x: a.unionByName(x), parts)


DIRECT_TITLES = {1: "Main Code (W.B.S)", 2: "Item Description", 3: "Division Name", 4: "Original Budget", 5: "BAC", 6: "Earned Value (EV)", 7: "Actual Cost",
                 8: "ETC", 9: "EAC", 10: "Work Performed Qty", 11: "Final QS Qty", 12: "Client Invoice %"}
INDIRECT_TITLES = {1: "Main Code", 3: "Item Description", 4: "Original Budget", 5: "Earned Value", 6: "Actual Cost", 7: "Cost Variance", 8: "BAC", 9: "Project Progress"}


def direct_sheet(spark, sf, files) -> DataFrame:
    d = written(b.direct_details(spark, sf), "direct-details")
    row = code_number() * 1000 + text_rank("division")
    num = [("original_budget", 4), ("bac", 5), ("ev", 6), ("ac", 7), ("etc", 8), ("eac", 9), ("work_qty", 10), ("final_qs_qty", 11), ("invoice_pct", 12)]
    body = sheet(d, C("project"), "Direct Details", 2, row, [
        _cell(1, C("main_code")), _cell(2, C("description")), _cell(3, C("division"))] + [_cell(c, C(n), True) for n, c in num])
    totals = d.groupBy("project", "division").agg(total_sum("original_budget").alias("v"))
    extra = sheet(totals, C("project"), "Direct Details", 2, text_rank("division") + 1000000, [
        _cell(2, F.concat(F.lit("Total "), C("division"))), _cell(4, C("v"), True)])
    status = sheet(files, C("project"), "Direct Details", 2, F.lit(2000000), [_cell(2, "Total under budget"), _cell(4, F.lit(1.0), True)])
    return union([header(files, "Direct Details", 2, 3, DIRECT_TITLES), body, extra, status])


def indirect_sheet(spark, sf, files) -> DataFrame:
    d = b.indirect_details(spark, sf)
    body = sheet(d, C("project"), "Indirect Details", 3, code_number() + 5, [
        _cell(1, C("main_code")), _cell(3, C("description"))] + [_cell(c, C(n), True) for n, c in (
            ("original_budget", 4), ("ev", 5), ("ac", 6), ("cv", 7), ("bac", 8))])
    return union([header(files, "Indirect Details", 3, 2, INDIRECT_TITLES), body])


def cash_sheet(spark, sf, files) -> DataFrame:
    """Months in row 4, as serials or text; every June payment is a broken formula."""
    m = F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")
    d = b.cash(spark, sf).withColumn("c", (m - 1995 * 12 + 1).cast("long"))
    serial = F.datediff(F.to_date(F.concat(C("month"), F.lit("-01"))), F.lit("1899-12-30").cast("date")).cast("double")
    odd = m % 2 == 1
    june = C("month").endswith("-06")
    none_s, none_n = F.lit(None).cast("string"), F.lit(None).cast("double")

    def line(row, s, n):
        return F.struct(F.lit(row).cast("long").alias("row"), C("c").alias("col"), s.alias("value_str"), n.alias("value_num"))

    cells = F.array(
        line(4, F.when(~odd, C("month")), F.when(odd, serial)), line(5, none_s, C("cash_in")),
        line(6, F.when(june, F.lit("#NAME?")).otherwise(none_s), F.when(~june, C("cash_out")).otherwise(none_n)))
    body = d.select(C("project").alias("file"), F.inline(cells)).filter("value_str IS NOT NULL OR value_num IS NOT NULL").select(
        "file", F.lit("Cash Flow").alias("sheet"), F.lit(4).alias("sheet_idx"), "row", "col", "value_str", "value_num", F.lit(None).cast("string").alias("formula"))
    return union([header(files, "Cash Flow", 4, 5, {1: "Total Cash-In"}), header(files, "Cash Flow", 4, 6, {1: "Total Cash-Out"}), body])


LEDGER_TITLES = {1: "D/I", 2: "Main Code", 3: "Sub Code", 4: "Source", 5: "Description", 6: "Currency", 7: "Total Qty", 8: "Total Cost"}


def ledger_sheet(spark, sf, files) -> DataFrame:
    led = written(b.ledger(spark, sf), "ledger", source=b.table(spark, sf, "lineitem"))  # titles, rows and months read it
    supp = F.regexp_extract("resource", r"(\d+)$", 1).cast("long")
    row = ((code_number() * 100000000 + supp) * 100 + F.ascii("source")) * 2 + F.when(C("di") == "I", 1).otherwise(0) + 10
    body = sheet(led, C("project"), "Expense Ledger", 5, row, [
        _cell(1, C("di")), _cell(2, C("main_code")), _cell(3, C("resource")), _cell(4, C("source")), _cell(5, F.concat_ws(" ", "main_code", "resource")),
        _cell(6, "EGP"), _cell(7, C("total_qty"), True), _cell(8, F.when(C("source") == "A", C("total_cost")), True)])

    def mcol(month):
        return ((F.substring(month, 1, 4).cast("int") - 1995) * 12 + F.substring(month, 6, 2).cast("int")).cast("long") * 3 + 20

    entries = led.select("project", row.alias("row"), F.inline("months"))
    triple = F.array(*[F.struct((mcol("month") + o).alias("col"), F.lit(None).cast("string").alias("value_str"), C(n).alias("value_num"))
                       for o, n in ((0, "qty"), (1, "unit_price"), (2, "total"))])
    months = entries.select(C("project").alias("file"), "row", F.inline(triple)).select(
        "file", F.lit("Expense Ledger").alias("sheet"), F.lit(5).alias("sheet_idx"), "row", "col", "value_str", "value_num", F.lit(None).cast("string").alias("formula"))
    used = entries.select("project", "month").distinct()

    def title(r, o, text):
        return F.struct(F.lit(r).cast("long").alias("row"), (mcol("month") + o).alias("col"), text.alias("value_str"), F.lit(None).cast("double").alias("value_num"))

    heads = used.select(C("project").alias("file"), F.inline(F.array(
        title(3, 0, C("month")), title(4, 0, F.lit("Qty")), title(4, 1, F.lit("U.P")), title(4, 2, F.lit("Total"))))).select(
        "file", F.lit("Expense Ledger").alias("sheet"), F.lit(5).alias("sheet_idx"), "row", "col", "value_str", "value_num", F.lit(None).cast("string").alias("formula"))
    return union([header(files, "Expense Ledger", 5, 3, LEDGER_TITLES), heads, body, months])


def pools_sheet(spark, sf, files) -> DataFrame:
    lines = b.cost_lines(spark, sf, part=True).filter("raw_di = 'I'")
    gran = lines.groupBy("project", C("division").alias("category")).agg(line_sum("ac").alias("cost"))
    off = lines.groupBy("project", C("source").alias("category")).agg(line_sum("ac").alias("cost"))
    row = text_rank("category")
    return union([
        header(files, "Indirect Cost", 6, 1, {1: "Category", 2: "Cost", 4: "Category", 5: "Cost"}),
        sheet(gran, C("project"), "Indirect Cost", 6, row, [_cell(1, C("category")), _cell(2, C("cost"), True)]),
        sheet(off, C("project"), "Indirect Cost", 6, row, [_cell(4, C("category")), _cell(5, C("cost"), True)]),
        sheet(files, C("project"), "Indirect Cost", 6, F.lit(200), [_cell(1, "Total Indirect Cost"), _cell(2, F.lit(1.0), True)]),
        sheet(files, C("project"), "Indirect Cost", 6, F.lit(201), [_cell(4, "Reallocated Equipment"), _cell(5, F.lit(2.0), True)])])


def breakdown_sheet(spark, sf, files) -> DataFrame:
    d = written(b.boq_resources(spark, sf), "boq-resources")
    base = code_number() * 100000000 + 30
    codes = d.select("project", "main_code").distinct()
    supp = F.regexp_extract("resource", r"(\d+)$", 1).cast("long")
    return union([
        header(files, "Direct Breakdown", 7, 1, {1: "Code", 2: "Item", 3: "Resource", 4: "Actual Cost"}),
        sheet(codes, C("project"), "Direct Breakdown", 7, base, [_cell(1, C("main_code")), _cell(2, F.concat(F.lit("Works of "), C("main_code")))]),
        sheet(d, C("project"), "Direct Breakdown", 7, base + supp + 1, [_cell(3, C("resource")), _cell(4, C("actual_cost"), True)])])


WASTE_LABELS = [(3, WASTE_ROWS["actual"], "actual"), (4, WASTE_ROWS["engineering"], "engineering"), (5, "% Actual Waste", "pct"),
                (6, "% Budget Waste", "budget"), (7, "Actual Waste Quantity", "qty")]


def waste_columns(spark, sf) -> DataFrame:
    """Material columns 2-5: steel and concrete, each split by discounted and full-price lines."""
    p = b.table(spark, sf, "part").select("p_partkey", "p_type")
    li = b.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    op = b.order_projects(spark, sf, "o_orderkey", "project")
    col = F.when(C("p_type") == "STANDARD", 2).otherwise(4) + F.when(C("l_discount") > 0.05, 1).otherwise(0)
    g = (li.join(p, C("l_partkey") == C("p_partkey")).join(op, C("l_orderkey") == C("o_orderkey"))
         .groupBy("project", col.cast("long").alias("c"))
         .agg(line_sum("l_quantity").alias("actual"), line_sum(C("l_quantity") * (1 - C("l_discount"))).alias("engineering")))
    qty = C("actual") - C("engineering")
    return g.select("*", qty.alias("qty"), (qty / C("engineering")).alias("pct"), F.lit(0.04).alias("budget"))


def waste_sheet(spark, sf, files) -> DataFrame:
    w = waste_columns(spark, sf)
    cells = F.array(*[F.struct(F.lit(r).cast("long").alias("row"), C("c").alias("col"), F.lit(None).cast("string").alias("value_str"), C(n).alias("value_num"))
                      for r, _, n in WASTE_LABELS])
    body = w.select(C("project").alias("file"), F.inline(cells)).select(
        "file", F.lit("Waste").alias("sheet"), F.lit(8).alias("sheet_idx"), "row", "col", "value_str", "value_num", F.lit(None).cast("string").alias("formula"))
    return union([header(files, "Waste", 8, 1, {2: "Steel", 4: "Concrete"})]
                 + [header(files, "Waste", 8, r, {1: t}) for r, t, _ in WASTE_LABELS] + [body])


def direct_units_sheet(spark, sf, files) -> DataFrame:
    """The direct sheet with a unit column."""
    d = b.direct_details(spark, sf)
    unit = F.concat(F.lower(F.substring("division", 1, 1)), F.lit("2"))
    body = sheet(d, C("project"), "Direct Details", 2, code_number() * 1000 + text_rank("division"), [_cell(20, unit)])
    return union([direct_sheet(spark, sf, files), header(files, "Direct Details", 2, 3, {20: "Unit"}), body])


RESOURCE_TITLES = {1: "No.", 3: "Resource Name", 4: "Resource Code", 5: "Actual Cost", 6: "Work Performed Qty", 7: "EAC"}


def resource_sheets(spark, sf, files) -> DataFrame:
    """A sheet for each direct code: the code above the header, a second code right below it; codes with an even number have a rate column.

    One more sheet of every project names a code that no direct row has.
    """
    d = written(b.boq_resources(spark, sf), "boq-resources")
    supp = F.regexp_extract("resource", r"(\d+)$", 1).cast("long")
    name, idx = F.concat(F.lit("Res "), C("main_code")), (code_number() + 100).cast("int")
    even = code_number() % 2 == 0
    codes = d.select("project", "main_code").distinct().unionByName(files.select("project", F.lit("Z.1").alias("main_code")))

    def placed(rows, row, cells):
        return rows.select(C("project").alias("file"), name.alias("sheet"), idx.alias("sheet_idx"), row.cast("long").alias("row"), F.inline(F.array(*cells))).filter(
            "value_str IS NOT NULL OR value_num IS NOT NULL").withColumn("formula", F.lit(None).cast("string"))

    return union([
        placed(codes, F.lit(1), [_cell(1, "Resource sheet"), _cell(2, "Z.9")]), placed(codes, F.lit(2), [_cell(4, C("main_code"))]),
        placed(codes.filter("main_code <> 'Z.1'"), F.lit(3), [_cell(1, "B.11"), _cell(12, "Resource Code")]),
        placed(codes, F.lit(4), [_cell(c, t) for c, t in RESOURCE_TITLES.items()] + [_cell(8, F.when(even, F.lit("Actual Rate (L.E)")))]),
        placed(codes, F.lit(5), [_cell(3, "#N/A"), _cell(5, F.lit(1.0), True)]), placed(codes, F.lit(6), [_cell(3, F.lit(12.0), True), _cell(5, F.lit(1.0), True)]),
        placed(codes, F.lit(7), [_cell(3, "Without cost"), _cell(6, F.lit(1.0), True)]), placed(codes.filter("main_code = 'Z.1'"), F.lit(8), [_cell(3, "Labour"), _cell(5, F.lit(1.0), True)]),
        placed(d, supp + 10, [_cell(1, supp, True), _cell(3, C("resource")), _cell(4, F.concat(F.lit("R-"), supp)), _cell(5, C("actual_cost"), True), _cell(6, C("work_qty"), True),
                              _cell(7, C("eac"), True), _cell(8, F.when(even, C("actual_cost") * 2), True)])])


def short_project() -> Column:
    """True for about half of the projects: their sheets lack what the others have."""
    return F.length("project") % 2 == 0


def reallocation_sheet(spark, sf, files) -> DataFrame:
    """Groups of three columns over the codes; half of the projects have only the first group."""
    lines = b.cost_lines(spark, sf, part=True).filter("raw_di = 'I'")
    amounts = lines.groupBy("project", F.regexp_replace("main_code", "^Brand#", "B.").alias("main_code")).agg(
        *[line_sum(F.when(C("source") == s, C("ac"))).alias(n) for s, n in (("A", "other_cost"), ("R", "equipment"))])
    both = files.filter(~short_project())
    body = sheet(amounts, C("project"), "Reallocation", 10, code_number() + 5, [
        _cell(2, C("main_code")), _cell(3, "A.1"), _cell(4, F.lit(0.5), True), _cell(6, C("other_cost"), True), _cell(9, F.when(~short_project(), C("equipment")), True)])
    return union([header(files, "Reallocation", 10, 2, {4: "Other  Costs"}), header(both, "Reallocation", 10, 2, {7: "Equipment", 9: "Other Costs"}),
                  header(files, "Reallocation", 10, 3, {4: "Share", 5: "Base", 6: "Amount"}), body])


#: Rows of the full waste sheet: row, label, field.
WASTE_FIELDS = [(4, "اجمالي " + WASTE_ROWS["actual"], "actual"), (5, "اجمالي " + WASTE_ROWS["engineering"], "engineering"), (6, WASTE_ROWS["unit"], "unit"), (7, WASTE_ROWS["stock"], "stock"),
                (8, OWNER_QUANTITY[0], "owner"), (9, "Actual Waste Quantity", "qty"), (10, "% Actual Waste", "pct"), (11, "% Budget Waste", "budget"), (12, "Waste Variance", "variance"),
                (13, WASTE_ROWS["avg_price"], "price"), (14, "Total Actual Cost of Waste", "cost"), (15, "Total Actual Cost of Waste", "later")]


def waste_fields_sheet(spark, sf, files) -> DataFrame:
    """Materials as columns, fields as rows. Half of the projects have no rows of waste quantity and share, the last column has no engineering figure."""
    w = waste_columns(spark, sf).select(
        "project", "c", C("actual"), F.when(C("c") < 5, C("engineering")).alias("engineering"), F.floor(C("actual") / 10).alias("stock"), (C("engineering") - 1).alias("owner"), (C("qty") + 0.5).alias("qty"),
        (C("pct") + 0.01).alias("pct"), "budget", (C("pct") - C("budget")).alias("variance"), F.when(C("c") < 4, 12.5).otherwise(3.25).alias("price"), (C("qty") * 3).alias("cost"), F.lit(1.0).alias("later"))
    short = short_project()
    cells = F.array(F.struct(F.lit(3).cast("long").alias("row"), F.concat(F.lit("Item "), C("c")).alias("value_str"), F.lit(None).cast("double").alias("value_num")), *[
        F.struct(F.lit(r).cast("long").alias("row"), F.when(F.lit(n == "unit"), F.when(C("c") < 4, "t").otherwise("m3")).alias("value_str"),
                 (F.lit(None) if n == "unit" else F.when(~short | F.lit(n not in ("qty", "pct")), C(n))).cast("double").alias("value_num")) for r, _, n in WASTE_FIELDS])
    body = w.select(C("project").alias("file"), C("c").alias("col"), F.inline(cells)).filter("value_str IS NOT NULL OR value_num IS NOT NULL").select(
        "file", F.lit("Waste").alias("sheet"), F.lit(8).alias("sheet_idx"), "row", "col", "value_str", "value_num", F.lit(None).cast("string").alias("formula"))
    full = files.filter(~short)
    # the headings of the two materials stand in different rows
    return union([header(files, "Waste", 8, 1, {2: "Steel"}), header(files, "Waste", 8, 2, {4: "Concrete"}), body]
                 + [header(full if n in ("qty", "pct") else files, "Waste", 8, r, {1: t}) for r, t, n in WASTE_FIELDS])


def dashboard_sheet(spark, sf) -> DataFrame:
    """Headline labels and numbers of every project, plus a notes sheet with a weaker candidate."""
    m = b.project_model(spark, sf)

    def cell(row, col, text=None, num=None, sheet="Dashboard", idx=1):
        return F.struct(
            F.lit(sheet).alias("sheet"), F.lit(idx).alias("sheet_idx"), F.lit(row).cast("long").alias("row"), F.lit(col).cast("long").alias("col"),
            (F.lit(text) if text is None or isinstance(text, str) else text).cast("string").alias("value_str"),
            (F.lit(None) if num is None else num).cast("double").alias("value_num"))

    cells = [
        cell(2, 1, "Total Budget Cost"), cell(2, 2, num=C("m_budget")), cell(3, 1, "Total Earned  Value"), cell(3, 3, num=C("m_earned_value")),
        cell(4, 1, "Total Actual Cost"), cell(5, 1, num=C("m_actual_cost")),
        cell(7, 1, "Actual Direct Cost"), cell(7, 2, F.concat(F.lit("$"), F.floor("m_direct_cost").cast("string"))),
        cell(8, 1, "CPI"), cell(8, 2, "n/a"), cell(12, 1, "Revenue"), cell(12, 2, num=C("m_revenue")),
        cell(13, 1, "Revenue per m2"), cell(13, 4, num=F.lit(5.0)), cell(14, 1, "Net Profit"), cell(14, 2, num=C("m_gross_profit")),
        cell(14, 9, "#DIV/0!"), cell(1, 1, "earned value", None, "Notes", 9), cell(1, 2, None, F.lit(1.0), "Notes", 9)]
    placed = m.select(C("name").alias("file"), F.inline(F.array(*cells)))
    return placed.filter("value_str IS NOT NULL OR value_num IS NOT NULL").withColumn("formula", F.lit(None).cast("string"))


def code_register(spark, sf) -> DataFrame:
    """Parallel triplets from the part table: odd parts sit in the right band, some one column left."""
    p = b.table(spark, sf, "part")
    k = C("p_partkey")
    code = F.concat(F.lit("B."), F.regexp_extract("p_brand", r"(\d+)$", 1), F.lit("."), (k % 500).cast("string"))
    band = F.when(k % 2 == 0, 1).otherwise(5).cast("long")
    shift = F.when((k % 2 == 1) & (k % 3 == 0), 1).otherwise(0)

    def cell(col, v):
        return F.struct(col.cast("long").alias("col"), v.cast("string").alias("value_str"))

    body = p.select((F.floor(k / 2) + 2).cast("long").alias("row"), F.inline(F.array(
        cell(band - shift, code), cell(band + 1, C("p_name")), cell(band + 2, C("p_type")))))
    head = spark.range(1).select(F.lit(1).cast("long").alias("row"), F.inline(F.array(*[
        cell(F.lit(c), F.lit(t)) for c, t in ((1, "Cost Code"), (2, "Description"), (3, "Account Type"), (5, "Code"), (6, "Description"), (7, "Type"))])))
    return body.unionByName(head).select(
        F.lit("register").alias("file"), F.lit("Cost Codes").alias("sheet"), F.lit(1).alias("sheet_idx"), "row", "col", "value_str",
        F.lit(None).cast("double").alias("value_num"), F.lit(None).cast("string").alias("formula"))


SHEETS = {"direct": direct_sheet, "indirect": indirect_sheet, "cash": cash_sheet, "ledger": ledger_sheet, "pools": pools_sheet,
          "breakdown": breakdown_sheet, "waste": waste_sheet, "direct_units": direct_units_sheet, "resources": resource_sheets, "reallocation": reallocation_sheet,
          "waste_fields": waste_fields_sheet}


def workbook_cells(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """Cells of the named sheets of every project workbook, stored once as Parquet: extraction reads them several times, each time some of the columns.

    The tables that the sheets were laid out from are removed then.
    """
    files = b.table(spark, sf, "nation").select(C("n_name").alias("project"))
    laid_out = union([SHEETS[n](spark, sf, files) for n in names])
    cells = written(laid_out, "workbook-cells", source=b.table(spark, sf, "lineitem"))
    removed(laid_out)
    return cells


def book_cells(spark, sf) -> DataFrame:
    """The part and supplier tables as two sheets of one file: header in row 1, row = key + 2."""
    def one(t, idx, key, cols):
        rows = b.table(spark, sf, t)
        cells = [_cell(i, C(c), n) for i, (c, n) in enumerate(cols, 1)]
        head = spark.range(1).withColumn("project", F.lit("book"))
        return union([header(head, t, idx, 1, {i: c for i, (c, _) in enumerate(cols, 1)}), sheet(rows, F.lit("book"), t, idx, C(key) + 2, cells)])

    return union([
        one("part", 1, "p_partkey", [("p_partkey", True), ("p_name", False), ("p_brand", False), ("p_type", False), ("p_size", True), ("p_retailprice", True)]),
        one("supplier", 2, "s_suppkey", [("s_suppkey", True), ("s_name", False), ("s_acctbal", True)])])
