"""Streams have to give the batch result, also when an old period arrives late or a run restarts."""

from pathlib import Path

from ledgerloom.operators.history import latest_per_project
from ledgerloom.streaming import watch

SCHEMA = "project string, period string, fingerprint string, processed_at int"


def put(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/part={n}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def test_history_and_latest_with_a_late_period(spark):
    folder = watch.run_folder(spark, "t-history")
    put(spark, folder, 1, [("a", "2024-02", "f1", 1), ("b", "2024-01", "g1", 1)])
    watch.finish(watch.start_history(stream(spark, folder), folder))
    put(spark, folder, 2, [("a", "2024-01", "f0", 2)])
    put(spark, folder, 3, [("b", "2024-03", "g2", 3), ("a", "2024-02", "f1", 3)])
    watch.finish(watch.start_history(stream(spark, folder), folder))
    got = {r["project"]: r["fingerprint"] for r in watch.read_latest(spark, folder).collect()}
    assert got == {"a": "f1", "b": "g2"}
    assert watch.read_history(spark, folder).count() == 4
    watch.finish(watch.start_history(stream(spark, folder), folder))  # nothing new: nothing changes
    assert watch.read_history(spark, folder).count() == 4


def test_refresh_writes_only_changed_signatures(spark):
    folder = watch.run_folder(spark, "t-refresh")
    put(spark, folder, 1, [("a", "2024-02", "f1", 1)])
    watch.finish(watch.start_refresh(stream(spark, folder), folder))
    put(spark, folder, 2, [("a", "2024-01", "f0", 2)])
    watch.finish(watch.start_refresh(stream(spark, folder), folder))
    ctx = spark.read.parquet(f"{folder}/contexts")
    assert ctx.count() == 1
    batch = latest_per_project(spark.read.schema(SCHEMA).parquet(f"{folder}/in"))
    assert batch.select("project", "fingerprint").exceptAll(ctx.select("project", "fingerprint")).isEmpty()


def test_duplicate_sources_are_accepted_once(spark):
    folder = watch.run_folder(spark, "t-sources")
    schema = "path string, sha256 string"

    def add(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={n}")

    def run():
        src = spark.readStream.schema(schema).parquet(f"{folder}/in/*")
        watch.finish(watch.start_new_sources(src, folder))

    add(1, [("b", "1"), ("a", "1"), ("c", "2"), ("a", "1")])
    run()
    add(2, [("d", "2"), ("e", "3")])
    run()
    want = [("a", "1", "accepted"), ("a", "1", "duplicate"), ("b", "1", "duplicate"), ("c", "2", "accepted"), ("d", "2", "duplicate"), ("e", "3", "accepted")]
    assert sorted(map(tuple, watch.read_sources(spark, folder).collect())) == want
    # a batch that was judged but not committed is judged again: the same rows, once
    last = max(int(p.name) for p in Path(f"{folder}/checkpoint/commits").iterdir() if p.name.isdigit())
    Path(f"{folder}/checkpoint/commits/{last}").unlink()
    (Path(f"{folder}/checkpoint/commits") / f".{last}.crc").unlink(missing_ok=True)
    run()
    assert sorted(map(tuple, watch.read_sources(spark, folder).collect())) == want
