"""Boundary tables of the assessment rules."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import rules as op

N = None


def run(spark, names, rows, status):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} double" for n in names))
    return [r[0] for r in df.orderBy("i").select(status(*[F.col(n) for n in names])).collect()]


@pytest.mark.parametrize("rule,names,cases", [
    (op.cost_performance, ["ev", "ac", "cpi", "cv"], [
        ((0.0, 0.0, N, N), "unavailable"), ((N, N, N, N), "unavailable"), ((100.0, 100.0, N, N), "favorable"), ((95.0, 100.0, N, N), "critical"),
        ((96.0, 100.0, N, N), "caution"), ((94.9, 100.0, N, N), "critical"), ((100.0, 50.0, N, N), "favorable"), ((0.0, 10.0, N, N), "critical"),
        ((N, N, 0.95, N), "caution"), ((N, N, 0.949, N), "critical"), ((100.0, 0.0, N, N), "favorable")]),
    (op.profitability_methods, ["n", "l", "m"], [
        ((0.0, 0.0, 0.0), "unavailable"), ((2.0, 2.0, 2.0), "critical"), ((2.0, 1.0, 2.0), "mixed"), ((2.0, 0.0, 2.0), "caution"), ((2.0, 0.0, 1.0), "mixed"), ((2.0, 0.0, 0.0), "favorable")]),
    (op.profitability, ["profit", "margin"], [
        ((N, N), "unavailable"), ((-1.0, N), "critical"), ((1.0, -0.1), "critical"), ((1.0, N), "caution"), ((1.0, 0.0), "favorable"), ((0.0, 0.0), "favorable")]),
    (op.cash, ["cin", "cout", "net", "neg"], [
        ((N, N, N, N), "unavailable"), ((0.0, 0.0, 0.0, 0.0), "unavailable"), ((0.0, 10.0, -10.0, 0.0), "critical"), ((100.0, 115.0, -15.0, 0.0), "critical"),
        ((100.0, 114.0, -14.0, 0.0), "caution"), ((100.0, 90.0, 10.0, 1.0), "caution"), ((100.0, 90.0, 10.0, 0.0), "favorable"), ((N, N, 5.0, N), "favorable")]),
    (op.waste, ["sa", "sb", "ca", "cb"], [
        ((N, 0.1, N, 0.1), "unavailable"), ((0.08, 0.04, N, N), "critical"), ((0.06, 0.04, 0.0, 0.04), "caution"), ((0.05, 0.05, 0.03, 0.04), "favorable")]),
    (op.reconciliation, ["a", "r"], [
        ((N, 1.0), "unavailable"), ((0.0, 0.0), "unavailable"), ((106.0, 100.0), "critical"), ((105.0, 100.0), "caution"), ((101.0, 100.0), "favorable"), ((5.0, 0.0), "favorable")]),
    (op.concentration, ["top", "total"], [
        ((N, 1.0), "unavailable"), ((2.0, 1.0), "unavailable"), ((-1.0, 5.0), "unavailable"), ((41.0, 100.0), "critical"), ((40.0, 100.0), "caution"), ((25.0, 100.0), "favorable")]),
    (op.forecast, ["n", "rem", "etc", "bac"], [
        ((0.0, 1.0, 1.0, 1.0), "unavailable"), ((1.0, N, 1.0, 1.0), "informational"), ((1.0, 10.0, 16.0, 100.0), "critical"), ((1.0, 10.0, 15.0, 100.0), "caution"),
        ((1.0, 10.0, 99.0, 0.0), "caution"), ((1.0, 10.0, 10.0, 100.0), "favorable")]),
    (op.indirect_variance, ["b", "a", "v"], [
        ((N, 1.0, N), "unavailable"), ((0.0, 1.0, N), "unavailable"), ((100.0, 106.0, N), "critical"), ((100.0, 105.0, N), "caution"), ((100.0, 100.0, N), "favorable")]),
    (op.data_quality, ["s", "w", "u"], [((1.0, 0.0, 0.0), "critical"), ((0.0, 0.0, 1.0), "critical"), ((0.0, 2.0, N), "caution"), ((N, N, N), "favorable")]),
])
def test_rule_boundaries(spark, rule, names, cases):
    assert run(spark, names, [c for c, _ in cases], rule) == [s for _, s in cases]


def flow(spark, nets):
    rows = [("p", f"2024-{i:02d}", float(a), float(b)) for i, (a, b) in enumerate(nets, 1)]
    return spark.createDataFrame(rows, "project string, month string, cash_in_cum double, cash_out_cum double")


def trend_status(spark, nets):
    m = op.cash_trend_metrics(flow(spark, nets))
    cols = ["periods", "slope", "r_squared", "forecast_next_net", "last_net", "max_residual_z", "latest_cash_in", "latest_cash_out"]
    return m.select(op.cash_trend(*[F.col(c) for c in cols])).first()[0]


def test_cash_trend(spark):
    assert trend_status(spark, [(0, 100), (10, 110), (20, 120)]) == "critical"
    assert trend_status(spark, [(1, 2), (3, 4)]) == "unavailable"
    assert trend_status(spark, [(10, 0), (20, 0), (30, 0), (40, 0)]) == "favorable"
    assert trend_status(spark, [(100, 0), (60, 0), (20, 0)]) == "critical"  # next point falls below zero
    flat = op.cash_trend_metrics(flow(spark, [(5, 0)] * 4)).first()
    assert flat["r_squared"] == 1 and flat["max_residual_z"] == 0


def test_guard_needs_metrics_and_confidence(spark):
    df = spark.sql("""SELECT * FROM VALUES ('a', map('ev', 1D, 'ac', 1D), 0.49D), ('b', map('ev', CAST(NULL AS DOUBLE)), 0.9D), ('c', map('ev', 1D, 'ac', 1D), 0.5D)
        AS t(id, metrics, confidence)""").withColumn("semantic_type", F.lit("cost_performance"))
    got = {r["id"]: (r["status"], r["result_confidence"]) for r in op.evaluate(df).collect()}
    assert got == {"a": ("unavailable", 0.0), "b": ("unavailable", 0.0), "c": ("favorable", 0.5)}


def test_first_result_of_a_family_wins(spark):
    rows = [("p", 1, "cost_table", "favorable"), ("p", 0, "cost_performance", "critical"), ("q", 0, "waste", "mixed")]
    df = spark.createDataFrame(rows, "project_id string, ordinal int, semantic_type string, status string").selectExpr(
        "*", "'c' AS component_id", "'t' AS component_name", "0.9D AS result_confidence", "'2024' AS period")
    got = {(r["project_id"], r["family"]): r["severity"] for r in op.risk_report(df).collect()}
    assert got == {("p", "cost_performance"): "critical", ("q", "waste"): "caution"}
