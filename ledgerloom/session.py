"""Session defaults and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


#: Bytes of a stored table for one task of a shuffled join.
PART_BYTES = 8 << 20
#: Removes the shuffle files of a statement when it ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("ledgerloom")
    conf = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "16g"),
        **extra,
    }
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a session without that setting (tests, one machine) gets a fresh folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise a plan in the shared folder, so that lost executors do not redo it."""
    spark = df.sparkSession
    folder = work_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, *folders: str, source: DataFrame | None = None) -> DataFrame:
    """A plan as a Parquet table in the shared folder, columnar and read back by later steps; ``folders`` are its partition columns.

    Once the table stands nothing reads the shuffle files of its plan again: they are removed, so that the disk of a query is that of its
    largest step and not of all its steps. With ``source``, a stored table, the plan's shuffles have parts that follow its size.
    """
    path = f"{work_dir(df.sparkSession)}/ledgerloom/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    wanted = {FILE_CLEANUP: "true"}
    if source is not None:
        wanted[PARTITIONS] = str(max(int(conf.get(PARTITIONS, "200")), parts_of(source)))
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        df.write.partitionBy(*folders).option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(plan: DataFrame) -> None:
    """Deletes the tables of ``written`` that a plan reads; only for plans that are done, over tables nothing else reads."""
    spark = plan.sparkSession
    own = f"{work_dir(spark).rstrip('/')}/ledgerloom/"
    for folder in {f[:f.index(own) + len(own)] + f.partition(own)[2].partition("/")[0] for f in plan.inputFiles() if own in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parts_of(source: DataFrame) -> int:
    """How many pieces of PART_BYTES a stored table has; a plan of unknown size has the session's number of shuffle partitions."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, -(-size // PART_BYTES)) if size < 1 << 60 else int(source.sparkSession.conf.get(PARTITIONS, "200"))


def plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of a plan, NULL where the session does not expose it."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:
        return None


def blocks_of(source: DataFrame) -> int:
    """As many parts as the session has for shuffles, or more where a table has more pieces of PART_BYTES."""
    return max(int(source.sparkSession.conf.get(PARTITIONS, "200")), parts_of(source))


def dealt_by_size(df: DataFrame, key: str, source: DataFrame, lookup: DataFrame) -> DataFrame:
    """Rows dealt by a join key to parts of about PART_BYTES of the scan behind them, where the scan of the lookup side is above
    the session's autoBroadcastJoinThreshold.

    The part of one task, and so the memory of its sort, stays as it is while the table grows, whatever number of shuffle
    partitions the session has.
    """
    return df if fits_broadcast(lookup) else df.repartition(parts_of(source), key)


def fits_broadcast(lookup: DataFrame) -> bool:
    """Whether a scan is below the session's autoBroadcastJoinThreshold."""
    return int(str(lookup._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= _broadcast_bound(lookup.sparkSession)


def dealt_to_groups(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys before they are grouped: where nearly each row is a group of its own, a row is smaller than its partial sums.

    There are as many parts as the session has for shuffles, or more where ``source``, a stored table, has more pieces of PART_BYTES.
    """
    parts = parts_of(source)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get(PARTITIONS, "200")) else df.repartition(*keys)


def _broadcast_bound(spark: SparkSession) -> int:
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    digits = "".join(ch for ch in limit if ch.isdigit() or ch == "-")
    return int(digits) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(limit.rstrip("bB")[-1:].lower(), 1)


def broadcast_if_small(df: DataFrame, *sources: DataFrame) -> DataFrame:
    """Hint a lookup side for broadcasting only while the scans behind it are small.

    A join's own estimate is the product of its inputs, so the optimizer would rather
    broadcast the fact side; the measured scans settle it. The bound is the session's
    autoBroadcastJoinThreshold; above it the plan keeps its shuffle join.
    """
    bound = _broadcast_bound(df.sparkSession)
    sizes = [plan_bytes(s) for s in sources]
    if any(s is None for s in sizes) or sum(sizes) > bound:
        return df
    return F.broadcast(df)
