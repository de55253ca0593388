"""Snapshot JSON in, partitioned tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
SNAPSHOT_SCHEMA = (
    "schema_version int, project_id string, project_name string, reporting_period string, "
    "identity struct<project_sap_id:string,project_code:string>, source struct<filename:string,sha256:string,bytes:bigint>, "
    "metrics map<string,struct<preferred:struct<value:double,source_sheet:string,source_cell:string>>>, "
    "capabilities map<string,boolean>, manifest struct<sheet_count:int,unaccounted_sheets:int>, _corrupt string"
)


def read_snapshots(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Snapshot documents under the paths; an unreadable file is skipped, not fatal."""
    raw = spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").json(paths)
    return raw.withColumn("path", C("_metadata.file_path")).filter("_corrupt IS NULL").drop("_corrupt")


def parse_snapshots(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The same documents held as text, one per row."""
    parsed = F.from_json(text, SNAPSHOT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return texts.select(key, parsed.alias("s")).filter(C("s").isNotNull() & C("s._corrupt").isNull()).select(key, "s.*").drop("_corrupt")


def write_namespaced(df: DataFrame, path: str, keys: tuple[str, ...] = ("project_id", "period"), spread: str | None = None, files_per_key: int = 1) -> None:
    """Write under project/period folders; only the partitions present in ``df`` are replaced.

    ``spread`` names a column whose hash splits a hot partition over ``files_per_key`` tasks.
    """
    by = [C(k) for k in keys]
    if spread and files_per_key > 1:
        by.append(F.pmod(F.xxhash64(spread), F.lit(files_per_key)))
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_chunks(cells: DataFrame, path: str) -> None:
    """Cells with their chunk index, one folder per sheet and chunk."""
    cells.repartition("file", "sheet", "chunk_index").write.mode("overwrite").partitionBy("file", "sheet", "chunk_index").parquet(path)
