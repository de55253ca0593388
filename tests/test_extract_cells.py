"""Extraction from hand-written sheets: resource sheets, waste columns, reallocation groups."""

import pytest

from ledgerloom.operators import extract as ex


def cells(spark, sheets):
    """sheets: name -> {(row, col): text or number}, in the order of the workbook."""
    rows = [("f", name, i, r, c, v if isinstance(v, str) else None, None if isinstance(v, str) else float(v), None)
            for i, (name, grid) in enumerate(sheets.items()) for (r, c), v in grid.items()]
    return spark.createDataFrame(rows, "file string, sheet string, sheet_idx int, row long, col long, value_str string, value_num double, formula string")


def direct(spark, *rows):
    return spark.createDataFrame([("f", *r) for r in rows], "file string, main_code string, description string, unit string, row long")


RESOURCES = {(1, 1): "B.1", (2, 1): "Resource", (2, 2): "Resource Code", (2, 3): "Actual Cost", (2, 4): "Work Performed Qty", (3, 1): "Labor", (3, 2): "L-01", (3, 3): 100, (3, 4): 10}


def test_resources_need_a_verified_code(spark):
    sheet = cells(spark, {"Resource Sheet": RESOURCES})
    assert ex.boq_resources(sheet, direct(spark, ("A.1", "Verified work package", None, 5))).collect() == []
    one, = ex.boq_resources(sheet, direct(spark, ("B.1", "first", "m", 5), ("B.1", "last", "m2", 9))).collect()
    assert (one.main_code, one.description, one.unit, one.no, one.resource, one.resource_code, one.actual_cost, one.actual_rate) == ("B.1", "last", "m2", None, "Labor", "L-01", 100.0, 10.0)


def test_the_earliest_verified_code_names_the_sheet(spark):
    grid = {(r + 2, c): v for (r, c), v in RESOURCES.items() if r > 1} | {(1, 12): "B.3", (2, 9): "B.2", (3, 1): "B.1", (3, 6): "Sr", (6, 1): "#REF!", (6, 3): 4, (7, 1): "No quantity", (7, 3): 4, (7, 4): 0}
    known = direct(spark, ("B.1", "", None, 1), ("B.2", "", None, 2), ("B.3", "far right", None, 3))
    rows = ex.boq_resources(cells(spark, {"Sheet": grid}), known).collect()
    assert {(r.resource, r.main_code, r.description, r.actual_rate) for r in rows} == {("Labor", "B.2", "Sheet", 10.0), ("No quantity", "B.2", "Sheet", None)}


def test_a_code_far_down_or_right_names_the_sheet(spark):
    """Cells beyond the eighth row or the tenth column count where none before them holds a code."""
    low = {(r + 20, c): v for (r, c), v in RESOURCES.items() if r > 1} | {(15, 3): "B.2"}
    wide = {(r, c): v for (r, c), v in RESOURCES.items() if r > 1} | {(1, 30): "B.3"}
    known = direct(spark, ("B.2", "two", None, 1), ("B.3", "three", None, 2))
    rows = ex.boq_resources(cells(spark, {"Low": low, "Wide": wide}), known).collect()
    assert {(r.sheet, r.main_code, r.description) for r in rows} == {("Low", "B.2", "two"), ("Wide", "B.3", "three")}


WASTE = {(3, 2): "Material A", (3, 3): "Material B", (5, 1): "إجمالي الاستهلاك الفعلي", (5, 2): 10, (5, 3): 20, (6, 1): "إجمالي الاستهلاك الهندسي", (6, 2): 9, (6, 3): 18,
         (7, 1): "وحدة البند", (7, 2): "t", (7, 3): "m3", (8, 1): "تشوين", (8, 2): 0, (8, 3): 0, (9, 1): "الكميه المدرجه", (9, 2): 9, (9, 3): 18}


@pytest.mark.parametrize("extra", [{(10, 1): "Actual Waste Quantity", (10, 2): 1, (10, 3): 2}, {(1, 2): "Concrete", (1, 3): "Steel"}])
def test_waste_without_material_headings_is_unavailable(spark, extra):
    sheet = cells(spark, {"Waste": WASTE | extra})
    assert ex.waste_detail(sheet).collect() == [] == ex.waste_summary(sheet).collect()


def test_waste_columns_become_records(spark):
    grid = WASTE | {(1, 2): "Steel", (2, 3): "Concrete", (4, 2): "Rebar", (4, 5): "Only named", (10, 1): "% Actual Waste", (10, 2): 0.5, (11, 1): "Total actual cost of waste", (11, 3): 7, (12, 1): "Total actual cost of waste", (12, 3): 8}
    rows = {r.col: r for r in ex.waste_detail(cells(spark, {"Notes": {(1, 1): "x"}, "Waste": grid, "Later": grid})).collect()}
    assert sorted(rows) == [2, 3, 5] and {r.sheet for r in rows.values()} == {"Waste"}
    a, b, c = rows[2], rows[3], rows[5]
    assert (a.type, a.item, a.unit, a.actual, a.engineering, a.stock, a.owner_qty, a.waste_qty, a.waste_pct, a.budget_waste_pct) == ("Steel", "Rebar", "t", 10, 9, 0, 9, 1, 0.5, None)
    assert (b.type, b.item, b.waste_qty, b.waste_pct, b.waste_cost) == ("Concrete", None, 2, None, 7)  # the row of shares exists, so nothing is derived
    assert (c.item, c.actual, c.waste_qty) == ("Only named", None, None)
    assert a.evidence.source_row == 4 and a.evidence.source_header_row == 2


def test_reallocation_of_one_group_and_repeated_codes(spark):
    grid = {(2, 3): "Other Costs", (2, 7): "Equipment", (3, 1): "B.1", (3, 5): 10, (4, 2): "B.2", (4, 1): "not a code", (4, 5): "n/a", (5, 1): "B.1", (5, 5): 30, (6, 5): 99, (6, 8): 1}
    rows = ex.reallocation(cells(spark, {"No codes": {(1, 1): "Other Costs", (1, 3): "x"}, "Realloc": grid, "Later": grid})).collect()
    assert sorted(map(tuple, rows)) == [("f", "Realloc", "B.1", 30.0, None), ("f", "Realloc", "B.2", 0.0, None)]  # the block of Equipment leaves the sheet


def test_reallocated_amounts_stand_on_the_first_row_of_a_code(spark):
    breakdown = {(1, 1): "Code", (1, 3): "Resource", (1, 4): "Actual Cost", (2, 1): "B.1", (3, 3): "Steel", (3, 4): 5, (4, 3): "Sand", (4, 4): 6, (5, 1): "B.2", (6, 3): "Steel", (6, 4): 7}
    grid = {(2, 3): "Other Costs", (3, 1): "B.1", (3, 5): 10, (4, 1): "B.9", (4, 5): 11}
    rows = ex.reallocated_allocation(cells(spark, {"Breakdown": breakdown, "Realloc": grid})).collect()
    assert {(r.main_code, r.resource, r.other_cost_realloc, r.equipment_realloc) for r in rows} == {("B.1", "Steel", 10.0, 0.0), ("B.1", "Sand", 0.0, 0.0), ("B.2", "Steel", 0.0, 0.0)}


def test_headers_of_several_schemas_come_from_one_pass(spark):
    from ledgerloom.operators.cells import header_rows, headers_by_schema

    a, c = {"code": ["main code"], "cost": ["actual cost"]}, {"cost": ["actual cost"], "unit": ["unit"]}
    grid = {(2, 1): "Main Code", (2, 2): "Actual Cost", (3, 1): "unit", (4, 1): "Actual Cost", (4, 2): "Unit", (9, 1): "Main Code", (9, 2): "Actual Cost"} | {(r, 1): "unit" for r in range(10, 40)}
    sheet = cells(spark, {"One": grid, "Two": {(1, 1): "Main Code"}, "None": {(1, 1): "zzz"}})
    found = {(r.sheet, r.schema): (r.header_row, dict(zip(r.fields, r.cols)), r.score) for r in headers_by_schema(sheet, {"a": a, "c": c}).collect()}
    assert found == {("One", "a"): (2, {"code": 1, "cost": 2}, 24.0), ("One", "c"): (4, {"cost": 1, "unit": 2}, 24.0), ("Two", "a"): (1, {"code": 1}, 12.0)}
    assert {r.sheet: r.header_row for r in header_rows(sheet, a).collect()} == {"One": 2, "Two": 1}


def test_workbook_cells_and_ledger_rows_are_columnar_tables(spark):
    from conftest import SF
    from ledgerloom.plans import workbook as wb

    sheets = wb.workbook_cells(spark, SF, "ledger")
    assert any("workbook-cells" in f for f in sheets.inputFiles())
    rows = ex.ledger(sheets)
    assert any("ledger-rows" in f for f in rows.inputFiles())  # numbering does not read the cells twice
    assert rows.count() == rows.select("file", "row").distinct().count() > 0
