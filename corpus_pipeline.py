"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

Toxic documents go; one document of each group of near-duplicates (five-word shingles, 80 % of the union) stays; documents that hold a
benchmark window go; secrets are replaced by [kind]; the rest is encoded into pieces. Every row is a document of its own: the stages that
compare rows number them first, so that rows without an id, or of one id with different texts, are judged like all others. Stages keep the
columns of documents, whatever further ones there are; the last adds ``n_pieces`` and ``piece_ids``. Each stage is judged on its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, near_dup, pieces, secrets, toxicity
from ledgerloom.llm.common import written


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number each, written so that it stays theirs, and the name of its column."""
    name = "row"
    while name in docs.columns:
        name = "_" + name
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "pipeline-rows"), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay."""
    model = toxicity.train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.with_scores(docs, model, score_col="toxic_score__").filter("toxic_score__ < 0.5").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the row with the smallest id stays, one without an id only where none has one; a text without words is in no group."""
    rows, row = _numbered(docs)
    groups = near_dup.near_duplicates(rows, id_col=row).select(F.col("doc_id").alias("number"), "component_id")
    ids = rows.select(F.col(row).alias("number"), F.col("doc_id").cast("long").alias("id"))
    first = groups.join(ids, "number").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "number")).alias("first"))
    return rows.join(first.select(F.col("first.number").alias(row)), row, "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item stay."""
    rows, row = _numbered(docs)
    found = decontamination.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    return rows.join(found.filter("contaminated").select(F.col("doc_id").alias(row)), row, "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced; the number of characters follows the new text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else clean


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with n_pieces and piece_ids."""
    encoded = pieces.encode(docs, ids_col="piece_ids")
    return encoded.select(*(c for c in docs.columns if c not in ("piece_ids", "n_pieces")), F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("sentencepiece", encode_pieces)]

#: SQL has no compression distance and no piece automaton; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
