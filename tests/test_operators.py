"""Operators against brute force or hand-made inputs."""

import difflib
import math
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import as_number, codeish, excel_month, line_sum, safe_date
from ledgerloom.functions.text import column_letters, split_ref
from ledgerloom.operators import banding, cells, extract, history, identity, text
from ledgerloom.plans.workbook import CELL_COLUMNS
from ledgerloom.sources import forms, workbooks

CELLS = "file string, sheet string, sheet_idx int, row long, col long, value_str string, value_num double, formula string"


def sheet(spark, triples, name="Sheet", file="f"):
    rows = [(file, name, 1, r, c, v if isinstance(v, str) else None, float(v) if not isinstance(v, str) else None, None) for r, c, v in triples]
    return spark.createDataFrame(rows, CELLS)


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(3)}", i, rng.choice([None, "a", "b", "c"]), rng.random() < 0.3) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, i int, v string, f boolean"), rows


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_banded_windows_equal_plain_ones(series):
    df, rows = series
    band = F.floor(F.col("i") / 64)
    number = {(r["k"], r["i"]): r["n"] for r in banding.row_number(df, ["k"], band, ["i"], "n").collect()}
    lagged = {(r["k"], r["i"]): r["p"] for r in banding.lag(df, ["k"], band, ["i"], "v", "p").collect()}
    filled = {(r["k"], r["i"]): r["c"] for r in banding.forward_fill(df, ["k"], band, ["i"], "v", "c").collect()}
    counted = {(r["k"], r["i"]): r["s"] for r in banding.running_count(df, ["k"], band, ["i"], F.col("f"), "s").collect()}
    for k, group in by_key(rows).items():
        prev, last, total = None, None, 0
        for n, (_, i, v, f) in enumerate(sorted(group, key=lambda r: r[1]), 1):
            last = v if v is not None else last
            total += f
            assert (number[k, i], lagged[k, i], filled[k, i], counted[k, i]) == (n, prev, last, total)
            prev = v


def test_islands_equal_a_plain_scan(spark):
    draw = random.Random(21)
    rows, want = [], {}
    for k in range(6):
        at, n, before = 0, 0, None
        for _ in range(draw.choice([1, 2, 60])):
            step = draw.choice([1, 1, 2, 3, 9, 40])
            at += step
            starts = before is None or at - before > 2
            n += starts
            rows.append((k, at))
            want[(k, at)] = (n, None if starts else before)
            before = at
    df = spark.createDataFrame(rows, "k int, i int").repartition(5)
    for size in (1, 4, 1000):
        found = banding.islands(df, ["k"], F.floor(F.col("i") / size), "i", 2, "n", "p").collect()
        assert {(r.k, r.i): (r.n, r.p) for r in found} == want, size


def test_line_sum_is_exact_in_any_order(spark):
    values = [0.1, 0.2, 0.3, 1e9 + 0.000001, -5.25] * 1000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    totals = {df.repartition(n).agg(line_sum("v")).first()[0] for n in (1, 3, 8)}
    assert totals == {float(sum(Decimal(str(v)).quantize(Decimal("0.000001")) for v in values))}
    assert df.filter("v > 1e12").agg(line_sum("v")).first()[0] is None


def test_numbers_codes_and_references(spark):
    df = spark.createDataFrame([("1,234.5",), ("EGP12",), ("12 %",), ("1e5",), ("",), ("-7",), ("abc",)], "t string")
    assert [r[0] for r in df.select(as_number("t")).collect()] == [1234.5, 12.0, None, None, None, -7.0, None]
    df = spark.createDataFrame([("A.1",), ("B-12/x",), ("#A.1",), ("1.2.3",), ("hello",), ("W12",), (None,)], "t string")
    assert [r[0] for r in df.select(codeish("t")).collect()] == [True, True, False, True, False, True, False]
    df = spark.range(1, 20000).select("id", column_letters(F.col("id")).alias("l"))
    row, col = split_ref(F.concat("l", F.lit("7")))
    assert df.filter((col != F.col("id")) | (row != 7)).count() == 0


def test_dates_are_never_guessed(spark):
    cases = {
        "2024-02-29": ("2024-02-29", None), "2023-02-29": (None, "unsupported or invalid text date: 2023-02-29"), "31-Jan-2024": ("2024-01-31", None),
        "1 March 2024": ("2024-03-01", None), "05/06/2024": (None, "ambiguous text date: 05/06/2024"), "05/05/2024": ("2024-05-05", None),
        "25/06/2024": ("2024-06-25", None), "06/25/70": ("1970-06-25", None), "06/25/69": ("2069-06-25", None), "13.07.99": ("1999-07-13", None),
        "05-06-2024": ("2024-06-05", None), "12-25-2024": ("2024-12-25", None), "31/31/2024": (None, "invalid text date: 31/31/2024"), "": (None, "missing"),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    d = df.orderBy("i").select(safe_date(F.col("t"), F.lit(None).cast("double"), F.lit(False)).alias("d")).select("d.*")
    assert [(str(r["value"]) if r["value"] else None, r["reason"]) for r in d.collect()] == list(cases.values())
    months = {"2024-03-05": "2024-03", "Mar-24": "2024-03", "Mar 2024": "2024-03", "2024-3": "2024-03", "x 2024.7 y": "2024-07", "13/2/2024": "2024-02", "junk": None}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(months)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(excel_month(F.col("t"))).collect()] == list(months.values())


def test_cash_sheet_keeps_zero_and_marks_errors(spark):
    c = sheet(spark, [(1, 2, "2024-01"), (1, 3, "2024-02"), (1, 4, "2024-02"), (2, 1, "Cash In"), (2, 2, 0), (2, 3, 50), (3, 1, "Cash Out"), (3, 2, "#NAME?"), (3, 3, 20)])
    rows = {r["month"]: r for r in extract.cashflow(c).collect()}
    assert set(rows) == {"2024-01", "2024-02"}
    assert rows["2024-01"]["cash_in"] == 0 and rows["2024-01"]["cash_out"] is None and rows["2024-01"]["cash_out_state"] == "formula_error"
    assert rows["2024-02"]["cash_in_cum"] == 50 and rows["2024-02"]["cash_out_cum"] == 20


def test_direct_sheet_with_reordered_columns(spark):
    heads = ["Description", "EAC", "Main Code", "Actual Cost", "Original Budget", "Earned Value", "BAC", "ETC", "Division"]
    vals = ["Works", 95, "A.1", 80, 100, 90, 100, 15, "Civil"]
    c = sheet(spark, [(2, i, h) for i, h in enumerate(heads, 1)] + [(3, i, v) for i, v in enumerate(vals, 1)] + [(4, 3, "#REF!")], "Direct Details")
    row = extract.direct_details(c).collect()
    assert len(row) == 1
    assert (row[0]["main_code"], row[0]["ac"], row[0]["original_budget"], row[0]["ev"], row[0]["division"], row[0]["unit"]) == ("A.1", 80, 100, 90, "Civil", None)


def test_ledger_takes_the_last_item_that_is_told(spark):
    heads = ["D/I", "Main Code", "Sub Code", "Source", "Description", "Currency", "Total Qty", "Total Cost", "Item 1", "Item 2", "Item 3"]
    vals = [["D", "A.1", "r", "S1", "x", "EGP", 1, 10, "one", "two", " "], ["D", "A.2", "r", "S2", "x", "EGP", 1, 10, "one", None, None], ["D", "A.3", "r", "S3", "x", "EGP", 1, 10, None, None, None]]
    cells = [(3, i, h) for i, h in enumerate(heads, 1)] + [(4, 20, "Qty")] + [(5 + k, i, v) for k, row in enumerate(vals) for i, v in enumerate(row, 1) if v is not None]
    assert {r["main_code"]: r["item"] for r in extract.ledger(sheet(spark, cells, "Expense Ledger")).collect()} == {"A.1": "two", "A.2": "one", "A.3": "S3"}


def test_waste_without_material_headers_is_unavailable(spark):
    rows = [(1, 1, "Actual Waste Quantity"), (2, 1, "% Actual Waste"), (3, 1, "% Budget Waste"), (4, 1, "Waste Variance"), (5, 1, "تشوين"), (1, 2, 5), (2, 2, 0.1)]
    assert extract.waste_summary(sheet(spark, rows)).count() == 0
    headed = rows + [(8, 2, "Steel"), (8, 3, "Concrete"), (1, 3, 7)]
    got = {r["kind"]: (r["steel"], r["concrete"]) for r in extract.waste_summary(sheet(spark, headed)).collect()}
    assert got["waste_qty"] == (5, 7) and got["waste_pct"] == (0.1, 0.0)


def test_regions_split_on_gaps(spark):
    block = [(r, c, "t" * 3 if r in (2, 20) else 1) for r in (2, 3, 4, 20, 22, 23, 24) for c in (1, 2)]
    short = [(40, 1, "abc"), (40, 2, "def"), (41, 1, 1), (41, 2, 1)]
    reg = cells.table_regions(sheet(spark, block + short)).orderBy("header_row").collect()
    assert [(r["header_row"], r["end_row"], r["row_count"]) for r in reg] == [(2, 4, 2), (20, 24, 3)]
    assert reg[0]["headers"] == ["ttt", "ttt"] and reg[0]["columns"] == [1, 2]


def test_semantic_hash_ignores_metadata_but_not_values(spark):
    base = [(1, 1, "a"), (2, 1, 5)]

    def h(cells_):
        return history.semantic_fingerprint(cells_).first()["content_sha256"]

    a = h(sheet(spark, base))
    assert a == h(sheet(spark, list(reversed(base))).unionByName(sheet(spark, [(1, 1, "x")], " Metadata ")))
    assert a != h(sheet(spark, [(1, 1, "a"), (2, 1, 6)]))


def test_late_and_unknown_periods(spark):
    rows = [("a", "2024-02", "f1", 1), ("a", "2024-01", "f2", 2), ("b", "2024-05", "g1", 1), ("b", "unknown", "g2", 2), ("c", "2024-05", "h1", 1), ("c", "unknown", "h2", 2), ("c", "2024-01", "h3", 3)]
    df = spark.createDataFrame(rows, "project string, period string, fingerprint string, processed_at int")
    got = {r["project"]: r["fingerprint"] for r in history.latest_per_project(df).collect()}
    assert got == {"a": "f1", "b": "g2", "c": "h3"}
    assert history.revision_store(df).count() == 7


def test_identity_decisions(spark):
    reg = spark.createDataFrame([("p1", "S1", "C1", "One"), ("p2", "S2", "C2", "Two"), ("p3", None, None, "Legacy")],
                                "internal_project_id string, project_sap_id string, project_code string, project_name string")
    cases = [(" s1 ", "c1", "existing", "p1"), ("S1", "C2", "conflict", None), ("S9", "C9", "new", None), ("S9", "C1", "conflict", None), ("S1", "C9", "conflict", None),
             ("S2", None, "existing", "p2"), (None, "C9", "new", None), (None, None, "unresolved", None)]
    inc = spark.createDataFrame([(i, s, c, "Some name", "2024") for i, (s, c, _, _) in enumerate(cases)],
                                "i int, project_sap_id string, project_code string, project_name string, reporting_period string")
    got = [(r["status"], r["matched_project"]) for r in identity.resolve(inc, reg).orderBy("i").collect()]
    assert got == [(s, p) for _, _, s, p in cases]
    legacy = inc.limit(1).selectExpr("99 AS i", "'S8' AS project_sap_id", "'C8' AS project_code", "'LEGACY' AS project_name", "reporting_period")
    assert identity.resolve(legacy, reg).first()["reason"] == "same_name_without_identifiers"
    late = legacy.selectExpr("i", "project_sap_id", "project_code", "'Fresh' AS project_name", "CAST(NULL AS STRING) AS reporting_period")
    assert identity.resolve(late, reg).first()["reason"] == "missing_period"


def test_lexicon_similarity_equals_brute_force(spark):
    labels = ["Earnd Valeu", "Total Bugdet", "zzzz", "cost varianse", "Actual Cost", "AC", "physical progres %", "Revenues of sale"]
    got = {r["label"]: (r["metric"], round(r["score"], 9)) for r in text.lexicon_match(spark.createDataFrame([(x,) for x in labels], "label string")).collect()}
    for label in labels:
        n, best = " ".join(label.lower().replace("_", " ").split()), (None, -1.0)
        for m, al in text.LEXICON.items():
            for a in al:
                s = 1.0 if n == a else (min(0.97, 0.72 + min(len(a), len(n)) / max(len(a), len(n)) * 0.22) if a in n or n in a else difflib.SequenceMatcher(None, n, a).ratio())
                best = (m, s) if s > best[1] else best
        assert got.get(label) == ((best[0], round(best[1], 9)) if best[1] >= 0.58 else None), label


def test_scenarios_reconcile(spark):
    base = spark.createDataFrame([("a", 1e8, 7e7, 1e7, None, 55.0, 0.9), ("b", 5e6, None, None, None, None, None)],
                                 "project string, contract_price double, direct_budget double, indirect_budget double, fees_budget double, completion double, cpi double")
    s = text.scenario_table(base, [1, 2, 3])
    assert s.count() == 2 * 4 * 3 and s.exceptAll(text.scenario_table(base.repartition(5), [1, 2, 3])).count() == 0
    assert text.validate_scenarios(s, text.scenario_parts(s)).filter("size(errors) > 0").count() == 0
    broken = s.withColumn("total_budget", F.col("total_budget") + 1000)
    assert text.validate_scenarios(broken, text.scenario_parts(s)).filter("errors = array('total_budget')").count() == 24


def test_isolation_scores_find_the_outlier(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)] + [(999, 40.0, -40.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = text.anomaly_scores(df, "id", ["a", "b"]).toPandas().sort_values("score")
    assert got.iloc[0]["id"] == 999 and got.iloc[0]["score"] < 0
    assert (text.anomaly_scores(df.limit(4), "id", ["a", "b"]).toPandas()["score"] == 0).all()


def test_kmeans_and_cluster_count(spark):
    assert [text.cluster_count(n) for n in (1, 2, 3, 9, 64, 10**6)] == [1, 1, 2, 3, 8, 8]
    rows = [(i, [float(i // 50) * 10 + random.Random(i).random(), 0.0]) for i in range(100)]
    got = text.kmeans_clusters(spark.createDataFrame(rows, "id int, v array<double>"), "v", 2).toPandas()
    assert got[got["id"] < 50]["cluster"].nunique() == 1 and got["cluster"].nunique() == 2


def test_tfidf_vectors_have_unit_length(spark):
    docs = spark.createDataFrame([(1, "cost cost budget"), (2, "budget cash"), (3, "cash flow cost")], "id int, t string")
    w = text.tfidf(docs, "id", "t").toPandas()
    assert all(math.isclose(x, 1.0, rel_tol=1e-9) for x in (w["weight"] ** 2).groupby(w["id"]).sum())
    assert "cost cost" in set(w["term"])


def test_broken_workbook_is_rejected_not_fatal(spark):
    df = spark.createDataFrame(pd.DataFrame({"path": ["a.xlsx"], "content": [b"not a zip"]}))
    scanned = workbooks.scan_cells(df)
    assert workbooks.rejected(scanned).first()["error_type"] == "BadZipFile"
    assert workbooks.accepted_cells(scanned).count() == 0


def test_decoding_falls_back_by_encoding(spark):
    texts = {"utf8": "né €".encode(), "bom": b"\xef\xbb\xbfx", "u16": "né".encode("utf-16"), "cp": "€ “x”".encode("cp1252"), "latin": b"\x81\xe9"}
    df = spark.createDataFrame(pd.DataFrame({"path": list(texts), "content": list(texts.values())}))
    got = {r["path"]: r["text"] for r in forms.source_text(df).collect()}
    assert got == {"utf8": "né €", "bom": "x", "u16": "né", "cp": "€ “x”", "latin": "\x81é"}


def test_cell_columns_are_stable():
    assert CELL_COLUMNS == [p.split(" ")[0] for p in CELLS.split(", ")]
