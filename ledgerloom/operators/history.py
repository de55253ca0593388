"""Revisions, hashes, incremental plans and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
FAN = 256


def _ordered_hash(group: DataFrame, keys: list[str], order: str, text: str, name: str) -> DataFrame:
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return group.groupBy(*keys).agg(F.sha2(joined, 256).alias(name))


def semantic_fingerprint(cells: DataFrame) -> DataFrame:
    """Order-stable hash of (sheet, ref, value, formula) per file, without styles and metadata sheets.

    Hashed as a tree: one row of cells, blocks of 256 rows, blocks of 65 536 rows, then
    the sheet and the file. No task ever holds more than one block.
    """
    value = F.coalesce(C("value_str"), F.format_string("%.6f", C("value_num")), F.lit(""))
    d = cells.filter(F.lower(F.trim("sheet")) != "metadata").select(
        "file", "sheet", "row", "col", F.concat_ws("|", C("col").cast("string"), value, F.coalesce("formula", F.lit(""))).alias("text"))
    rows = _ordered_hash(d, ["file", "sheet", "row"], "col", "text", "h")
    rows = rows.select("file", "sheet", F.floor(C("row") / FAN).alias("b1"), "row",
                       F.concat_ws("|", C("row").cast("string"), C("h")).alias("t"))
    b1 = _ordered_hash(rows, ["file", "sheet", "b1"], "row", "t", "t").withColumn("b2", F.floor(C("b1") / FAN))
    b2 = _ordered_hash(b1, ["file", "sheet", "b2"], "b1", "t", "t")
    sheets = _ordered_hash(b2, ["file", "sheet"], "b2", "t", "h").withColumn("t", F.concat_ws("|", "sheet", "h"))
    return _ordered_hash(sheets, ["file"], "sheet", "t", "content_sha256")


def match_reference(sources: DataFrame, index: DataFrame) -> DataFrame:
    """Approved reference by exact hash, else by semantic hash: two equi-joins instead of an OR."""
    exact = index.groupBy(C("source_sha256").alias("fingerprint")).agg(F.min("entry").alias("exact_entry"))
    semantic = index.groupBy("content_sha256").agg(F.min("entry").alias("semantic_entry"))
    j = sources.join(exact, "fingerprint", "left").join(semantic, "content_sha256", "left")
    first = F.least("exact_entry", "semantic_entry")
    return j.select(
        *sources.columns, first.alias("entry"),
        F.when(C("exact_entry") == first, "exact_file_sha256").when(first.isNotNull(), "semantic_workbook_sha256").alias("match_mode"))


def incremental_status(files: DataFrame, state: DataFrame) -> DataFrame:
    """unchanged (same stat signature), duplicate (hash already processed) or process."""
    known = state.select("sha256").distinct().withColumn("seen", F.lit(True))
    prior = state.select("path", C("stat").alias("prior_stat"))
    j = files.join(prior, "path", "left").join(known, "sha256", "left")
    return j.select("path", F.when(C("stat") == C("prior_stat"), "unchanged").when(C("seen"), "duplicate").otherwise("process").alias("status"))


def restore_report(sources: DataFrame, history: DataFrame) -> DataFrame:
    """Counts of restored / present / blocked / failed sources; known fingerprints are skipped first."""
    known = history.select("fingerprint").distinct().withColumn("known", F.lit(True))
    j = sources.join(known, "fingerprint", "left")
    status = F.when(C("known"), "present").when(C("failed"), "failed").when(C("blocked"), "blocked").otherwise("restored")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def revision_store(revisions: DataFrame) -> DataFrame:
    """Every (project, period, fingerprint) once, with its last processing time and a period-latest flag."""
    kept = revisions.groupBy("project", "period", "fingerprint").agg(F.max("processed_at").alias("processed_at"))
    top = kept.groupBy("project", "period").agg(F.max_by("fingerprint", F.struct("processed_at", "fingerprint")).alias("top"))
    return kept.join(top, ["project", "period"]).withColumn("is_latest", C("fingerprint") == C("top")).drop("top")


def latest_per_project(revisions: DataFrame) -> DataFrame:
    """Latest revision per project: an older period never replaces a newer one, 'unknown' never blocks.

    An unknown period replaces whatever was there, so only what came with or after the last
    unknown counts. Aggregates only: no task orders a whole project.
    """
    known = C("period") != "unknown"
    order = F.struct("period", "processed_at", "fingerprint")
    last_unknown = revisions.filter(~known).groupBy("project").agg(
        F.max(F.struct("processed_at", "fingerprint")).alias("u"))
    j = revisions.join(last_unknown, "project", "left")
    alive = known & (C("u").isNull() | (C("processed_at") > C("u.processed_at")))
    g = j.groupBy("project").agg(F.max(F.when(alive, order)).alias("k"), F.max("u").alias("u"))
    return g.select(
        "project", F.coalesce("k.period", F.lit("unknown")).alias("period"),
        F.coalesce("k.fingerprint", "u.fingerprint").alias("fingerprint"), F.coalesce("k.processed_at", "u.processed_at").alias("processed_at"))


def registry_hash(registry: DataFrame, key: str, payload: Column) -> DataFrame:
    """Hash of the sorted registry payload plus the project count.

    A tree over the key hash: 65 536 leaves, 256 branches, one root, so that no group grows
    beyond a small share of the registry.
    """
    rows = registry.select(C(key).alias("k"), payload.alias("t")).withColumn("leaf", F.substring(F.sha2("k", 256), 1, 4))

    def level(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
        return df.groupBy(*keys).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))

    leaves = level(rows.withColumn("n", F.lit(1)), ["leaf"], "k", "t")
    branches = level(leaves.withColumn("branch", F.substring("leaf", 1, 2)), ["branch"], "leaf", "h")
    return level(branches, [], "branch", "h").select(C("h").alias("registry_fingerprint"), C("n").alias("project_count"))


def classify_change(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """unchanged / blocked / create / update / restore classes of candidate revisions."""
    fp = history.select("fingerprint").distinct().withColumn("same", F.lit(True))
    periods = history.select("project", "period").distinct().withColumn("has_period", F.lit(True))
    last = history.groupBy("project").agg(F.max("period").alias("current"))
    j = candidates.join(fp, "fingerprint", "left").join(periods, ["project", "period"], "left").join(last, "project", "left")
    return j.select(
        *candidates.columns,
        F.when(C("same"), "unchanged").when(~C("identity_status").isin("existing", "new"), "blocked")
        .when(C("identity_status") == "new", "create").when(C("has_period"), "update_same_period")
        .when(C("period") < C("current"), "restore_older").when(C("period") > C("current"), "update_newer")
        .otherwise("update_new_period").alias("classification"))


def index_differences(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Rows of either index missing from the other, duplicates counted."""
    a = left.exceptAll(right).withColumn("finding", F.lit(f"{name}:extra"))
    return a.unionByName(right.exceptAll(left).withColumn("finding", F.lit(f"{name}:missing")))


def delta_plan(local: DataFrame, remote: DataFrame) -> DataFrame:
    """NEW / UPDATE / unchanged / remote_only per path; remote-only files are never deleted implicitly."""
    j = local.select("path", C("sha").alias("l")).join(remote.select("path", C("sha").alias("r")), "path", "full_outer")
    return j.select("path", F.when(C("l").isNull(), "remote_only").when(C("l").eqNullSafe(C("r")), "unchanged")
                    .when(C("r").isNull(), "NEW").otherwise("UPDATE").alias("kind"))


def chronology(latest: DataFrame, history: DataFrame) -> DataFrame:
    """Latest equals the maximum period and its revision exists."""
    top = history.groupBy("project").agg(F.max("period").alias("max_period"))
    exists = history.select("project", "period", "fingerprint").distinct().withColumn("found", F.lit(True))
    j = latest.join(top, "project", "left").join(exists, ["project", "period", "fingerprint"], "left")
    return j.select("project", "period", ((C("period") == C("max_period")) & F.coalesce("found", F.lit(False))).alias("ok"))


def selected_revision(history: DataFrame, choice: DataFrame) -> DataFrame:
    """The chosen key, else the current fingerprint, else the last revision."""
    j = history.join(choice, "project")
    rank = F.when(C("fingerprint") == C("chosen"), 2).when(C("fingerprint") == C("current"), 1).otherwise(0)
    return j.groupBy("project").agg(F.max(F.struct(rank.alias("r"), C("period"), C("processed_at"), C("fingerprint"))).alias("s")).select(
        "project", "s.period", "s.fingerprint", F.element_at(F.array(F.lit("last"), F.lit("current"), F.lit("chosen")), C("s.r") + 1).alias("basis"))
