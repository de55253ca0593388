"""Registered streaming queries (H04, H17, H18): the stream has to equal the batch result."""

from pyspark.sql import functions as F

from ledgerloom.plans import bindings as b
from ledgerloom.plans.bindings import sql_with
from ledgerloom.plans.history_queries import LATEST_SQL, revisions
from ledgerloom.plans.identity_queries import STAMP, stamp
from ledgerloom.plans.registry import query
from ledgerloom.streaming import watch


SLICES = 3


def run_in_slices(spark, sf, folder, start):
    """All events in slices that arrive one after another; each continues the stream from its checkpoint.

    A slice takes events of the whole time range by hash, so every slice after the first brings late periods.
    """
    events = b.table(spark, sf, "events")
    for k in range(SLICES):
        events.filter(F.pmod(F.xxhash64("ts", "user_id"), F.lit(SLICES)) == k).write.parquet(f"{folder}/arrived/slice-{k}")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/arrived/slice-*")
        watch.finish(start(revisions(spark, sf, stream), folder))


LATEST = sql_with("SELECT project, CASE WHEN period='' THEN 'unknown' ELSE period END AS period, fingerprint, processed_at FROM ("
                  + LATEST_SQL + ")", "revisions")


@query("h17_continuous_refresh", LATEST)
def h17(spark, sf):
    folder = watch.run_folder(spark, "refresh")
    run_in_slices(spark, sf, folder, watch.start_refresh)
    from ledgerloom.operators.history import latest_per_project
    return latest_per_project(spark.read.parquet(f"{folder}/contexts").drop("batch")).withColumn("processed_at", stamp("processed_at"))


@query("h18_late_period_stream", sql_with(f"""
SELECT project, period, fingerprint, {STAMP.replace('ts,', 'p,')} AS processed_at, rn=1 AS is_latest FROM (SELECT *, row_number() OVER (PARTITION BY project, period ORDER BY p DESC, fingerprint DESC) AS rn
 FROM (SELECT project, period, fingerprint, max(processed_at) AS p FROM revisions GROUP BY 1,2,3))""", "revisions"))
def h18(spark, sf):
    folder = watch.run_folder(spark, "history")
    run_in_slices(spark, sf, folder, watch.start_history)
    return watch.read_history(spark, folder).withColumn("processed_at", stamp("processed_at"))


@query("h04_new_source_stream", f"""
WITH e AS (SELECT user_id||'/'||event_id AS path, sha256(props) AS sha256, event_id%{SLICES} AS slice FROM events),
 f AS (SELECT sha256, min(path) AS path FROM (SELECT *, min(slice) OVER (PARTITION BY sha256) AS first FROM e) WHERE slice=first GROUP BY 1)
SELECT e.path, e.sha256, CASE WHEN f.path IS NULL THEN 'duplicate' ELSE 'accepted' END AS status FROM e LEFT JOIN f ON f.sha256=e.sha256 AND f.path=e.path""")
def h04_stream(spark, sf):
    """Sources arrive in three slices, each continuing the stream; contents of the first slice come again in the later ones."""
    folder = watch.run_folder(spark, "sources")
    events = b.table(spark, sf, "events")
    for k in range(SLICES):
        events.filter(F.col("event_id") % SLICES == k).write.parquet(f"{folder}/arrived/slice-{k}")
        arrived = spark.readStream.schema(events.schema).parquet(f"{folder}/arrived/slice-*")
        sources = arrived.select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("path"), F.sha2("props", 256).alias("sha256"))
        watch.finish(watch.start_new_sources(sources, folder))
    return watch.read_sources(spark, folder)
