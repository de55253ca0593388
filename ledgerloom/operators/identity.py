"""Project identity: identifiers, metadata records, two-key resolution and registry upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import canonical_id, clean_text, safe_date, slug
from ledgerloom.operators import banding
from ledgerloom.session import written

C = F.col
# Metadata labels and the record fields they fill.
LABELS = {
    "project sap id": "project_sap_id",
    "sap project id": "project_sap_id",
    "project code": "project_code",
    "project name": "project_name",
    "report start": "report_start",
    "report finish": "report_finish",
    "project start": "project_start",
    "project finish": "project_finish",
    "project finish-eot": "project_finish_eot",
}
DATE_FIELDS = ["report_start", "report_finish", "project_start", "project_finish", "project_finish_eot"]
OPTIONAL_DATES = ["project_start", "project_finish", "project_finish_eot"]
FIELDS = ["project_sap_id", "project_code", "project_name", *DATE_FIELDS]


def identifier(text: Column, number: Column, is_bool: Column, number_format: Column) -> Column:
    """Identifier text of a typed cell; whole numbers keep the zero padding of a 0..0 format."""
    whole = number == F.floor(number)
    raw = F.floor(number).cast("string")
    padded = F.when(
        number_format.rlike("^0+$") & (F.length(raw) < F.length(number_format)), F.lpad(raw, F.length(number_format), "0")
    ).otherwise(raw)
    t = clean_text(text)
    return F.when(is_bool, None).when(number.isNotNull() & whole, padded).when(
        number.isNotNull(), number.cast("string")).when(t != "", t)


def label_field(label: Column) -> Column:
    """Record field of a metadata label, NULL when the label is unknown."""
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.try_element_at(names, F.lower(clean_text(label)))


def metadata_records(cells: DataFrame) -> DataFrame:
    """One record per file from its metadata sheet (label in column 1, value in column 2).

    The later row of a repeated label wins; dates that cannot be read safely give findings.
    """
    meta = cells.filter((F.lower(clean_text("sheet")) == "metadata") & C("col").isin(1, 2))
    rows = meta.groupBy("file", "row").agg(
        F.max(F.when(C("col") == 1, C("value_str"))).alias("label"),
        F.max(F.when(C("col") == 2, C("value_str"))).alias("value_str"),
        F.max(F.when(C("col") == 2, C("value_num"))).alias("value_num"),
        F.max(F.when(C("col") == 2, C("number_format"))).alias("number_format"),
        F.coalesce(F.bool_or(F.when(C("col") == 2, C("is_date_format"))), F.lit(False)).alias("is_date_format"),
    )
    rows = rows.withColumn("d", safe_date(C("value_str"), C("value_num"), C("is_date_format")))
    day, reason = C("d.value"), C("d.reason")
    field = label_field(C("label"))
    text = F.when(field.isin("project_sap_id", "project_code"),
                  identifier(C("value_str"), C("value_num"), F.lit(False), F.coalesce("number_format", F.lit("")))
                  ).when(field == "project_name", F.when(clean_text("value_str") != "", clean_text("value_str"))
                         ).otherwise(day.cast("string"))
    finding = F.when(
        field.isin(DATE_FIELDS) & reason.isNotNull() & ~(field.isin(OPTIONAL_DATES) & (reason == "missing")),
        F.concat(F.upper(field), F.lit("_UNRESOLVED")))
    typed = rows.select("file", "row", field.alias("field"), text.alias("value"), finding.alias("finding")).filter("field IS NOT NULL")
    rec = typed.groupBy("file").agg(
        *[F.max_by(F.when(C("field") == f, C("value")), F.when(C("field") == f, C("row"))).alias(f) for f in FIELDS],
        F.array_sort(F.collect_set("finding")).alias("findings"))
    return effective_dates(rec)


def effective_dates(rec: DataFrame) -> DataFrame:
    """Effective finish (extension first) and the period key, present only with both report dates."""
    period = F.when(C("report_start").isNotNull() & C("report_finish").isNotNull(),
                    F.concat_ws("_to_", "report_start", "report_finish"))
    return rec.select("*", F.coalesce("project_finish_eot", "project_finish").alias("effective_project_finish"), period.alias("reporting_period"))


def key_counts(registry: DataFrame) -> DataFrame:
    """kind, key, n, id: how many projects hold a key, and the least of them; one pass and one shuffle for all kinds.

    Kinds: sap, code, and name for projects that have neither. Blank keys count nowhere. Written in a folder per kind.
    """
    sap, code = canonical_id("project_sap_id"), canonical_id("project_code")
    name = F.when((sap == "") & (code == ""), canonical_id("project_name"))
    keys = registry.select("internal_project_id", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in (("sap", sap), ("code", code), ("name", name))])))
    counts = keys.filter("key <> ''").groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("internal_project_id").alias("id"))
    return written(counts, "registry-keys", "kind")


def resolve(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """existing / new / conflict / unresolved with a reason code, by SAP id and project code.

    Each key is looked up with its match count, so the lookup never multiplies rows. The registry is read once.
    """
    counts = key_counts(registry)

    def lookup(kind: str) -> DataFrame:
        return counts.filter(C("kind") == kind).select(C("key").alias(f"{kind}_key"), C("n").alias(f"{kind}_n"), C("id").alias(f"{kind}_id"))

    legacy = lookup("name").select("name_key", F.lit(True).alias("legacy"))
    j = (
        incoming.withColumn("sap_key", canonical_id("project_sap_id")).withColumn("code_key", canonical_id("project_code"))
        .withColumn("name_key", canonical_id("project_name"))
        .join(lookup("sap"), "sap_key", "left").join(lookup("code"), "code_key", "left")
        .join(legacy, "name_key", "left")
    )
    has_sap, has_code = C("sap_key") != "", C("code_key") != ""
    sap, code = F.when(C("sap_n") == 1, C("sap_id")), F.when(C("code_n") == 1, C("code_id"))
    status = (
        F.when((C("sap_n") > 1) | (C("code_n") > 1), "conflict:non_unique")
        .when(~has_sap & ~has_code, "unresolved:missing_identifiers")
        .when(has_sap & has_code & (sap == code), "existing:")
        .when(has_sap & has_code & sap.isNull() & code.isNull(), "new:")
        .when(has_sap & has_code & sap.isNull(), "conflict:code_belongs_to_existing")
        .when(has_sap & has_code & code.isNull(), "conflict:sap_belongs_to_existing")
        .when(has_sap & has_code, "conflict:different_projects")
        .when(has_sap, F.when(sap.isNotNull(), "existing:").otherwise("new:"))
        .otherwise(F.when(code.isNotNull(), "existing:").otherwise("new:"))
    )
    raw = F.split(status, ":")
    guarded = (
        F.when((raw[0] == "new") & C("legacy") & (C("name_key") != ""), F.lit("unresolved:same_name_without_identifiers"))
        .otherwise(status)
    )
    guarded = F.when(F.split(guarded, ":")[0].isin("existing", "new") & C("reporting_period").isNull(),
                     F.lit("unresolved:missing_period")).otherwise(guarded)
    parts = F.split(guarded, ":")
    return j.select(
        *incoming.columns, raw[0].alias("key_status"), parts[0].alias("status"), parts[1].alias("reason"),
        F.when(parts[0] == "existing", F.coalesce(sap, code)).alias("matched_project"))


def namespaces(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """Readable project id; a taken name gets eight hex digits of the key hash."""
    taken = registry.select(C("internal_project_id").alias("base_id")).distinct().withColumn("taken", F.lit(True))
    digest = F.substring(F.sha2(F.concat_ws("|", canonical_id("project_sap_id"), canonical_id("project_code")), 256), 1, 8)
    named = incoming.withColumn("base_id", slug("project_name")).withColumn("digest", digest)
    return named.join(taken, "base_id", "left").withColumn(
        "project_id", F.when(C("taken"), F.concat_ws("-", "base_id", "digest")).otherwise(C("base_id"))).drop("taken", "digest")


def load_registry(registry: DataFrame, latest: DataFrame, migration: DataFrame) -> DataFrame:
    """Registry plus projects seen only in snapshots, then controlled migration overrides."""
    cols = ["internal_project_id", "project_sap_id", "project_code", "project_name"]
    extra = latest.join(registry.select("internal_project_id"), "internal_project_id", "left_anti").select(
        *cols, F.lit("legacy_generated_data").alias("source"))
    base = registry.select(*cols, F.lit("metadata_sheet").alias("source")).unionByName(extra)
    m = migration.select("internal_project_id", C("project_sap_id").alias("m_sap"), C("project_code").alias("m_code"), F.lit(True).alias("mapped"))
    return base.join(m, "internal_project_id", "left").select(
        "internal_project_id", F.coalesce("m_sap", "project_sap_id").alias("project_sap_id"),
        F.coalesce("m_code", "project_code").alias("project_code"), "project_name",
        F.when(C("mapped"), "controlled_legacy_migration").otherwise(C("source")).alias("source"))


def conflict_register(problems: DataFrame) -> DataFrame:
    """Newest record per fingerprint; a repeated fingerprint replaces its entry."""
    cols = [c for c in problems.columns if c not in ("fingerprint", "detected_at")]
    return problems.groupBy("fingerprint").agg(
        F.max_by(F.struct(*cols), F.struct("detected_at", *cols)).alias("r"), F.max("detected_at").alias("detected_at"),
        F.count("*").alias("detections")).select("fingerprint", "detected_at", "detections", "r.*")


def change_history(updates: DataFrame, key: str, order: list[str], value: str, band: Column) -> DataFrame:
    """Rows where the value differs from the previous one (type-2 history)."""
    d = banding.lag(updates, [key], band, order, value, "previous")
    return d.filter(C("previous").isNull() | (C("previous") != C(value)))
