"""Incremental processing of newly arrived revisions with Structured Streaming.

State lives in the state store or in written tables under the shared work folder,
never in a driver variable: a restarted query continues from its checkpoint, and
replaying a micro-batch rewrites the same batch folder instead of adding rows twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators import history as hist
from ledgerloom.session import work_dir

C = F.col


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def start_history(revisions: DataFrame, folder: str, continuous: str | None = None) -> StreamingQuery:
    """Append every (project, period, fingerprint) to history, once per fingerprint and batch.

    ``continuous`` is a processing-time interval; without it the query processes what is
    available and stops (one-shot mode).
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.groupBy("project", "period", "fingerprint").agg(F.max("processed_at").alias("processed_at"))
        kept.write.mode("overwrite").parquet(f"{folder}/history/batch={batch_id}")

    writer = revisions.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """History over all batches: a late period is simply another row."""
    return hist.revision_store(spark.read.parquet(f"{folder}/history").drop("batch"))


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Latest revision per project: an old period that arrives late never replaces it."""
    return hist.latest_per_project(spark.read.parquet(f"{folder}/history").drop("batch"))


def _state(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """What the batch before left: one compacted table, whatever the number of batches."""
    return spark.read.parquet(f"{folder}/state/{(batch_id - 1) % 2}") if batch_id else None


def _keep(state: DataFrame, folder: str, batch_id: int) -> None:
    """Two folders take turns: a replayed batch still finds the state before it and rewrites its own."""
    state.write.mode("overwrite").parquet(f"{folder}/state/{batch_id % 2}")


def first_sources(sources: DataFrame) -> DataFrame:
    """(path, sha256, status) of a stream of sources: accepted where the content is seen for the first time, else duplicate.

    Of several paths that bring a new content in one batch the first by name is accepted. What was seen lies in the state store, a flag for each
    hash, so that a batch touches the state of its own hashes only.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new, least = not state.exists, None
        for pdf in batches:
            paths = pdf["path"].sort_values(ignore_index=True)
            if new and len(paths) and (least is None or paths[0] < least):  # the smallest so far waits until all are read
                paths, least = pd.concat([paths[1:], pd.Series([least] if least is not None else [], dtype=object)]), paths[0]
            yield pd.DataFrame({"path": paths, "sha256": key[0], "status": "duplicate"})
        state.update((True,))
        if least is not None:
            yield pd.DataFrame({"path": [least], "sha256": [key[0]], "status": ["accepted"]})

    told = sources.select("path", "sha256")
    return told.groupBy("sha256").applyInPandasWithState(judge, "path string, sha256 string, status string", "seen boolean", "append", GroupStateTimeout.NoTimeout)


def start_new_sources(sources: DataFrame, folder: str) -> StreamingQuery:
    """Judge newly arrived sources and write them batch by batch; a batch that is replayed writes its folder anew."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/judged/batch={batch_id}")

    writer = first_sources(sources).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(availableNow=True).start()


def read_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Every source that arrived, with its status."""
    return spark.read.parquet(f"{folder}/judged").drop("batch")


def start_refresh(revisions: DataFrame, folder: str) -> StreamingQuery:
    """Recompute project signatures only for batches that change them.

    The signature of a project is its latest (period, fingerprint). A batch whose projects
    keep their signature writes no new revision of the contexts.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cols = ["project", "period", "fingerprint", "processed_at"]
        merged = batch.select(*cols)
        prior = _state(spark, folder, batch_id)
        if prior is not None:
            merged = merged.unionByName(prior.select(*cols))
        _keep(hist.latest_per_project(merged).select(*cols), folder, batch_id)
        now = spark.read.parquet(f"{folder}/state/{batch_id % 2}")
        if prior is not None:
            now = now.join(prior.select("project", "period", "fingerprint"), ["project", "period", "fingerprint"], "left_anti")
        now.select(*cols).write.mode("overwrite").parquet(f"{folder}/contexts/batch={batch_id}")

    return revisions.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
