"""The stages of the corpus pipeline on a small table, each on its own input, and the registered queries against their SQL."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import catalog, decontamination, near_dup, secrets

SF = "/root/testdata/sf0.001"


def test_stages_decide_and_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    repeated = docs.limit(3)
    now = docs.unionByName(repeated).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))).cache()
    columns = docs.columns
    sizes = [now.count()]
    outputs = []
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).cache()
        outputs.append(now)
        sizes.append(now.count())
    assert [x.columns for x in outputs[:-1]] == [columns] * 4 and outputs[-1].columns == [*columns, "n_pieces", "piece_ids"]
    assert sizes[0] > sizes[1] > sizes[2] > 0 and sizes[3] == sizes[4] == sizes[5]
    deduped = near_dup.near_duplicates(outputs[1]).collect()
    assert all(r.kept for r in deduped) and len({r.doc_id for r in deduped}) == len(deduped)
    assert not decontamination.decontaminate(outputs[2], spark.read.parquet(f"{SF}/benchmark.parquet")).filter("contaminated").count()
    assert not secrets.secrets(outputs[3]).filter(F.size("base") > 0).count()
    assert outputs[4].filter("n_pieces <> size(piece_ids)").count() == 0
    assert outputs[4].filter("doc_id is null").count() == 1


def test_rows_without_an_id_or_with_one_id_are_judged_one_by_one(spark):
    """Null ids, shared ids, and columns of the caller (a map among them) whose names the stages use themselves."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    plain = lambda word: " ".join(f"{word}{i}" for i in range(40))
    rows = [(None, "before " + item + " after"), (None, plain("x")), (None, plain("x")), (5, plain("a")), (5, plain("b")), (5, plain("c") + " " + item), (6, plain("y")), (None, plain("y")), (7, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("caller's")).withColumn("number", F.create_map(F.lit("k"), F.lit(1))).withColumn("component_id", F.lit(1)).withColumn("toxic_score__x", F.lit(1))
    told = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert clean.columns == docs.columns and told(clean) == sorted([(i, t) for i, t in rows if item not in (t or "")], key=str)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert one.columns == docs.columns and told(one) == sorted([r for k, r in enumerate(rows) if k not in (2, 7)], key=str)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns and {r.row for r in out.collect()} <= {"caller's"}, name


def test_an_empty_table_passes_every_stage(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0


def test_run_gives_what_the_stages_give(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    want = {(r.doc_id, r.text, tuple(r.piece_ids)) for r in now.collect()}
    assert {(r.doc_id, r.text, tuple(r.piece_ids)) for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_every_operator_is_registered(spark):
    import __spark_entry__ as entry

    named = {k.split("_")[0] for k in catalog.QUERIES}
    assert named == {*(f"op{i}" for i in range(1, 14)), "pipeline"}
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(catalog.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    from check import compare

    message = compare(spark, duck, SF, name)[-1]
    assert not message, message
