"""Registered queries against their DuckDB statements on the smallest data set.

One query per operator family by default; LEDGERLOOM_ALL=1 runs every registered query.
"""

import os

import pytest

from conftest import SF

SAMPLE = [
    "s01_workbook_cells", "s06_html_fields", "s07_text_records", "s11_snapshot_json", "d03_numeric_coercion", "d08_table_regions", "d11_header_row_inference",
    "d14_month_parsing", "n01_direct_details", "n04_cashflow", "n05_cost_codes", "n08_ledger_aggregates", "n11_reallocation", "n13_waste_detail", "n14_boq_resources", "n17_cash_out_repair",
    "i03_safe_date", "i04_metadata_pivot", "i06_two_key_resolution", "i11_change_history", "h02_semantic_fingerprint", "h07_latest_per_project",
    "h10_change_classification", "h18_late_period_stream", "p01_project_base", "p05_cost_matrix", "p10_scenario_lab", "p18_latest_cash_completeness",
    "g05_resource_pareto", "g10_ledger_search", "r04_cost_performance", "r08_cash_trend_metrics", "r13_forecast_rule", "r29_batch_reading", "r31_project_lineage",
    "t02_recurring_terms", "t07_structural_anomaly", "t09_family_classification", "t11_scenario_parts", "x02_month_delta", "x07_deterioration_streak", "x12_drill_tree", "x21_transaction_quality",
]


def names():
    if os.environ.get("LEDGERLOOM_ALL"):
        import ledgerloom.plans.catalog  # noqa: F401
        from ledgerloom.plans.registry import QUERIES

        return sorted(QUERIES)
    return SAMPLE


@pytest.mark.parametrize("name", names())
def test_query_matches_oracle(spark, duck, name):
    from check import compare

    _, n, _, _, message = compare(spark, duck, SF, name)
    assert not message, message


def test_every_inventory_id_is_registered():
    import __spark_entry__ as entry

    counts = {"s": 17, "d": 22, "n": 24, "i": 11, "h": 18, "p": 18, "g": 21, "r": 35, "t": 14, "x": 26}
    have = {k.split("_")[0] for k in entry.queries()}
    want = {f"{f}{i:02d}" for f, n in counts.items() for i in range(1, n + 1)}
    assert want <= have, sorted(want - have)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_one_row_per_project(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == len({r["id"] for r in rows}) > 0
    assert {r["status"] for r in rows} <= {"critical", "caution", "favorable", "unavailable"}
