"""Datasets that several descriptor and lineage steps read are written once."""

from conftest import SF


def test_model_waste_and_evidence_are_written_once(spark):
    from ledgerloom.plans import descriptor_queries as d

    lines = d.shared_cells(spark, SF)
    for name, table in (("model", "project-model"), ("waste", "waste-"), ("evidence", "evidence-")):
        assert any(table in f for f in lines[name].inputFiles())
    assert lines["evidence"].count() > lines["model"].count() > 0
