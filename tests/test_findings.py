"""Findings counted in one pass, against plain Python over rows with nulls, repeats and missing partners."""

from collections import Counter

import pytest

from ledgerloom.operators import extended, identity
from ledgerloom.plans.history_queries import isolation_gate

LINES = [
    (1, 1, 10, 5.0, 1.0, 0.1, "2020-01-01"), (1, 1, 10, 5.0, 1.0, 0.1, "2020-01-01"), (1, 1, 99, -5.0, 0.0, 0.0, None), (1, 2, None, 5.0, -1.0, 0.0, "1980-01-01"),
    (None, 1, 10, None, None, None, "2020-01-01"), (None, 1, 11, 5.0, 1.0, 0.1, "2020-01-01"), (2, None, None, 0.0, 1.0, 0.1, "1990-01-01")]
LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double, l_tax double, l_shipdate string, kind string, n int"


@pytest.mark.parametrize("rows", [LINES, LINES * 3, []])
@pytest.mark.parametrize("parts", [[10, 11, 11, None, 50], []])
def test_transaction_findings(spark, rows, parts):
    lines = spark.createDataFrame([(*r, "x", 4) for r in rows], LINE).selectExpr("* EXCEPT (l_shipdate)", "CAST(l_shipdate AS timestamp) AS l_shipdate")
    got = {r["finding"]: r["rows"] for r in extended.transaction_findings(lines, spark.createDataFrame([(p,) for p in parts], "p_partkey long")).collect()}
    assert got == {
        "duplicate_transactions": sum(n - 1 for n in Counter(r[:2] for r in rows).values()), "unmapped_code": sum(r[2] is None or r[2] not in parts for r in rows),
        "missing_code": sum(r[2] is None for r in rows), "negative_value": sum(r[3] is not None and r[3] < 0 for r in rows),
        "zero_quantity": sum(r[4] is not None and r[4] <= 0 for r in rows), "zero_tax": sum(r[5] == 0 for r in rows),
        "bad_period": sum(r[6] is None or r[6] < "1990" for r in rows)}


SUMMARIES = [(1, "K1", "C1", 2, "f", 0), (2, "K1", None, 2, "f", 3), (3, None, None, 0, "f", 0), (3, None, None, 1, None, 0), (4, None, "C", 1, "g", None), (None, "K9", None, 1, "f", 1)]
SHEETS = [(1, "f"), (1, "f"), (2, "f"), (2, "h"), (2, None), (3, "f"), (4, None), (5, "f"), (5, "q"), (None, "f")]


@pytest.mark.parametrize("sums", [SUMMARIES, []])
@pytest.mark.parametrize("sheets", [SHEETS, []])
def test_isolation_gate(spark, sums, sheets):
    s = spark.createDataFrame(sums, "project long, sap_key string, code_key string, sheet_count long, fingerprint string, unaccounted long")
    got = Counter(tuple(r) for r in isolation_gate(s.select("project", "sap_key"), s, spark.createDataFrame(sheets, "project long, sheet_fingerprint string")).collect())
    want = Counter()
    for p, n in Counter(r[0] for r in sums).items():
        want[(p, "duplicate_project_id")] += n > 1
    for k, n in Counter(r[1] for r in sums if r[1]).items():
        want[(min(r[0] for r in sums if r[1] == k and r[0] is not None) if any(r[1] == k and r[0] is not None for r in sums) else None, "duplicate_key")] += n > 1
    listed = Counter(p for p, _ in sheets)
    for p, sap, code, n, _, left in sums:
        want[(p, "identity_missing")] += sap is None and code is None
        want[(p, "sheet_count_mismatch")] += n != (listed[p] if p is not None else 0)
        want[(p, "unaccounted_sheets")] += left is not None and left > 0
    stale = set()
    for p, f in sheets:
        own = [r[4] for r in sums if r[0] == p and p is not None] or [None]
        if any(g is None or (f is not None and f != g) for g in own):
            stale.add(p)
    for p in stale:
        want[(p, "sheet_fingerprint_mismatch")] += 1
    assert got == +want


def test_key_counts(spark):
    rows = [("p2", "S1", "C1", "A"), ("p1", " s1", None, "B"), ("p3", None, " ", "B  b"), ("p4", "", None, "b b"), ("p5", None, None, None)]
    reg = spark.createDataFrame([(*r, 1, "x") for r in rows], "internal_project_id string, project_sap_id string, project_code string, project_name string, n int, kind string")
    got = {(r["kind"], r["key"], r["n"], r["id"]) for r in identity.key_counts(reg).collect()}
    assert got == {("sap", "s1", 2, "p1"), ("code", "c1", 1, "p2"), ("name", "b b", 2, "p3")}
    assert identity.key_counts(reg.limit(0)).count() == 0
