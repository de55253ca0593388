"""Packed months of a ledger: the work follows the entries and not the calendar."""

import pytest
from ledgerloom.operators import normalize

LEDGER = "project string, months array<struct<month string, qty double, unit_price double, total double>>"
NAMES = ["2020-01", "2020-02", "2020-03", "2020-04", "2020-05"]


def test_months_are_placed_without_a_map(spark):
    """Sparse, full, single and empty lists of months; a quantity or a total may be null."""
    full = [(m, 1.0, 2.0, 2.0) for m in NAMES]
    rows = [("a", [("2020-02", 2.0, 1.5, 3.0), ("2020-05", None, None, 7.0)]), ("b", full), ("c", [("2020-01", 0.0, None, None)]), ("d", [("2020-05", 1.0, -1.0, -1.0)]), ("e", []), ("a", full[1:3])]
    ledger = spark.createDataFrame(rows, LEDGER)
    names = normalize.month_list(ledger)
    dense = normalize.unpack_ledger(normalize.pack_ledger(ledger, names), names)
    want = []
    for project, months in rows:
        held = {m: (m, q, u, t or 0.0) for m, q, u, t in months}
        want.append((project, [held.get(m, (m, None, None, 0.0)) for m in NAMES]))
    assert dense.columns == ["project", "months"]
    assert sorted(((r["project"], [tuple(m) for m in r["months"]]) for r in dense.collect()), key=str) == sorted(want, key=str)
    assert "map_from_entries" not in dense._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("months", [[(None, 1.0, 1.0, 1.0)], [("2020-01", 1.0, 1.0, 1.0), ("2020-01", 2.0, 1.0, 2.0)]])
def test_months_missing_or_repeated_are_refused(spark, months):
    ledger = spark.createDataFrame([("a", [("2020-01", 1.0, 1.0, 1.0)]), ("b", months)], LEDGER)
    names = normalize.month_list(ledger)
    with pytest.raises(Exception, match="no month or repeats one"):
        normalize.unpack_ledger(normalize.pack_ledger(ledger, names), names).collect()
