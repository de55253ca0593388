"""The measure cube against plain sums, and the scans left in the queries that read its cells."""

from collections import defaultdict

import pytest
from conftest import SF
from ledgerloom.operators.cube import measure_cube

SCHEMA = "a string, b long, c string, x double, y double, n long, level string"
ROWS = [
    ("p", 1, "u", 0.1, 1.0, 7, "z"), ("p", 1, "u", 0.2, None, 7, "z"), ("p", 1, "v", -3.5, None, 7, "z"), ("p", None, "v", 2.25, 4.0, 7, "z"),
    (None, 2, "u", 1e9, 5.0, 7, "z"), (None, 2, "u", 1e9, 5.0, 7, "z"), ("", 2, None, None, None, 7, "z"), (None, None, None, 0.000001, 6.0, 7, "z"),
]
LEVELS = {"ab": ("a", "b"), "ca": ("c", "a"), "abc": ("a", "b", "c")}


def plain(rows, keys):
    at = [SCHEMA.split(", ").index(next(f for f in SCHEMA.split(", ") if f.startswith(k + " "))) for k in keys]
    cells = defaultdict(lambda: [0, None, None])
    for r in rows:
        cell = cells[tuple(r[i] for i in at)]
        cell[0] += 1
        for k, v in ((1, r[3]), (2, r[4])):
            if v is not None:
                cell[k] = round((cell[k] or 0) + v, 6)
    return {(*k, *v) for k, v in cells.items()}


@pytest.mark.parametrize("rows", [ROWS, ROWS * 3, []])
@pytest.mark.parametrize("wanted", [["ab", "ca", "abc"], ["ca"]])
def test_cells_equal_plain_sums(spark, rows, wanted):
    """Null keys, repeated rows, missing measures, an empty table and columns named like those of the cube."""
    lines = spark.createDataFrame(rows, SCHEMA)
    cube = measure_cube(lines, {k: LEVELS[k] for k in wanted}, ("x", "y"))
    assert list(cube) == wanted
    for level in wanted:
        assert cube[level].columns == [*LEVELS[level], "n", "x", "y"]
        got = [tuple(r) for r in cube[level].collect()]
        assert len(got) == len(set(got)) and set(got) == plain(rows, LEVELS[level])


def test_levels_with_the_same_keys_are_refused(spark):
    lines = spark.createDataFrame(ROWS, SCHEMA)
    with pytest.raises(ValueError, match="same keys"):
        measure_cube(lines, {"ab": ("a", "b"), "ba": ("b", "a")}, ("x",))
    assert measure_cube(lines, {}, ("x",)) == {}


@pytest.mark.parametrize("name", ["n08_ledger_aggregates", "n15_forecast_register", "n18_kpi_block", "r12_concentration_rule", "x08_management_exceptions", "x14_control_totals"])
def test_groupings_read_cells_and_no_lines(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "l_orderkey" not in plan
    assert "cost-cells" in plan
