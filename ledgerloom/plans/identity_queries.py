"""Registered identity queries."""

from pyspark.sql import functions as F

from ledgerloom.functions import canonical_id, safe_date
from ledgerloom.operators import identity as op
from ledgerloom.plans import bindings as b
from ledgerloom.plans.bindings import sql_with
from ledgerloom.plans.registry import query

C = F.col
STAMP = "strftime(ts,'%Y-%m-%d %H:%M:%S.%f')"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query("i01_canonical_identifier", r"""
SELECT c_custkey, lower(trim(regexp_replace('  '||c_name||chr(9)||' '||c_mktsegment||' ','\s+',' ','g'))) AS key FROM customer""")
def i01(spark, sf):
    raw = F.concat(F.lit("  "), C("c_name"), F.lit("\t "), C("c_mktsegment"), F.lit(" "))
    return b.table(spark, sf, "customer").select("c_custkey", canonical_id(raw).alias("key"))


@query("i02_typed_identifier", """
SELECT p_partkey, kind, CASE kind WHEN 0 THEN CASE WHEN p_size%2=0 THEN lpad(CAST(p_partkey AS VARCHAR),CAST(greatest(7,len(CAST(p_partkey AS VARCHAR))) AS INT),'0') ELSE CAST(p_partkey AS VARCHAR) END
 WHEN 1 THEN CASE WHEN p_retailprice=floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END
 WHEN 2 THEN p_name END AS identifier FROM part, (VALUES (0),(1),(2),(3)) v(kind)""")
def i02(spark, sf):
    p = b.table(spark, sf, "part")
    no_text, no_num = F.lit(None).cast("string"), F.lit(None).cast("double")
    fmt = F.when(C("p_size") % 2 == 0, "0000000").otherwise("General")
    cells = [
        (no_text, C("p_partkey").cast("double"), False, fmt), (no_text, C("p_retailprice"), False, F.lit("General")),
        (F.concat(F.lit(" "), C("p_name"), F.lit("  ")), no_num, False, F.lit("")), (F.lit("TRUE"), no_num, True, F.lit("")),
    ]
    return p.select("p_partkey", F.inline(F.array(*[
        F.struct(F.lit(i).alias("kind"), op.identifier(t, n, F.lit(bo), f).alias("identifier")) for i, (t, n, bo, f) in enumerate(cells)])))


LAYOUTS = ["yyyy-MM-dd", "d-MMM-yyyy", "d-MMMM-yyyy", "d-MMM-yy", "d MMM yyyy", "dd.MM.yyyy", "MM-dd-yyyy", "dd/MM/yyyy", "MM/dd/yyyy"]


@query("i03_safe_date", r"""
SELECT o_orderkey, kind, CASE WHEN kind<=5 OR kind=9 THEN d WHEN kind=6 THEN CASE WHEN day(d)<=12 THEN make_date(year(d),day(d),month(d)) ELSE d END
  WHEN kind IN (7,8) THEN CASE WHEN day(d)<=12 AND day(d)<>month(d) THEN NULL ELSE d END END AS value,
 CASE WHEN kind=7 AND day(d)<=12 AND day(d)<>month(d) THEN 'ambiguous text date: '||strftime(d,'%d/%m/%Y')
  WHEN kind=8 AND day(d)<=12 AND day(d)<>month(d) THEN 'ambiguous text date: '||strftime(d,'%m/%d/%Y') WHEN kind=10 THEN 'numeric date has no Excel date format'
  WHEN kind=11 THEN 'unsupported or invalid text date: '||strftime(d,'%Y')||' week' WHEN kind=12 THEN 'missing' END AS reason
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey%13 AS INT) AS kind FROM orders)""")
def i03(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", C("o_orderdate").cast("date").alias("d"), (C("o_orderkey") % 13).cast("int").alias("kind"))
    text = F.lit(None).cast("string")
    for i, layout in enumerate(LAYOUTS):
        text = F.when(C("kind") == i, F.date_format("d", layout)).otherwise(text)
    text = F.when(C("kind") == 11, F.concat(F.year("d").cast("string"), F.lit(" week"))).otherwise(text)
    number = F.when(C("kind").isin(9, 10), F.datediff("d", F.lit("1899-12-30").cast("date")).cast("double"))
    return o.select("o_orderkey", "kind", safe_date(text, number, C("kind") == 9).alias("d")).select("o_orderkey", "kind", "d.*")


def metadata_cells(spark, sf):
    """A metadata sheet per supplier: label in column 1, value in column 2."""
    k = C("s_suppkey")
    none_s, none_n = F.lit(None).cast("string"), F.lit(None).cast("double")

    def row(n, label, text=none_s, num=none_n, fmt="", is_date=F.lit(False)):
        one = F.struct(F.lit(n).alias("row"), F.lit(1).alias("col"), F.lit(label).alias("value_str"), none_n.alias("value_num"),
                       F.lit("").alias("number_format"), F.lit(False).alias("is_date_format"))
        two = F.struct(F.lit(n).alias("row"), F.lit(2).alias("col"), text.alias("value_str"), num.alias("value_num"),
                       F.lit(fmt).alias("number_format"), is_date.alias("is_date_format"))
        return [one, two]

    start = F.when(k % 11 == 0, "03/04/2024").otherwise(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int")), "yyyy-MM-dd"))
    rows = (
        row(1, "Project SAP  ID", F.when(k % 4 == 0, F.concat(F.lit(" sap-"), k.cast("string"), F.lit(" "))),
            F.when(k % 4 != 0, (k + 1000).cast("double")), "0000000")
        + row(2, "PROJECT CODE", F.concat(F.lit("C-"), F.lpad(k.cast("string"), 6, "0")))
        + row(3, "Project name", F.concat(F.lit("Project  "), (k % 40).cast("string")))
        + row(4, "Report Start", start) + row(5, "Report Finish", num=(k % 5 + 45322).cast("double"), is_date=k % 13 != 0)
        + row(6, "Project Start", F.lit("15.06.2020")) + row(7, "Project Finish", F.lit("31-Dec-2025"))
        + row(8, "Project Finish-EOT", F.when(k % 3 == 0, F.lit("1 March 2026"))) + row(9, "Prepared by", F.lit("nobody"))
    )
    return b.table(spark, sf, "supplier").select(
        C("s_name").alias("file"), F.lit("Metadata").alias("sheet"), F.inline(F.array(*rows)))


b.define("metadata", """SELECT s_name AS file, CASE WHEN k%4=0 THEN 'sap-'||k ELSE lpad(CAST(k+1000 AS VARCHAR),CAST(greatest(7,len(CAST(k+1000 AS VARCHAR))) AS INT),'0') END AS project_sap_id,
 'C-'||lpad(CAST(k AS VARCHAR),6,'0') AS project_code, 'Project '||(k%40) AS project_name,
 CASE WHEN k%11<>0 THEN strftime(DATE '2024-01-01'+CAST(k%28 AS INT),'%Y-%m-%d') END AS report_start,
 CASE WHEN k%13<>0 THEN strftime(DATE '1899-12-30'+CAST(45322+k%5 AS INT),'%Y-%m-%d') END AS report_finish,
 '2020-06-15' AS project_start, '2025-12-31' AS project_finish, CASE WHEN k%3=0 THEN '2026-03-01' END AS project_finish_eot,
 (k%11=0)::INT+(k%13=0)::INT AS n_findings FROM (SELECT s_name, s_suppkey AS k FROM supplier)""")


@query("i04_metadata_pivot", sql_with("SELECT file, project_sap_id, project_code, project_name, report_start, report_finish, project_start, project_finish, project_finish_eot, n_findings FROM metadata", "metadata"))
def i04(spark, sf):
    rec = op.metadata_records(metadata_cells(spark, sf))
    return rec.select("file", *op.FIELDS, F.size("findings").alias("n_findings"))


@query("i05_effective_dates", sql_with("""
SELECT file, coalesce(project_finish_eot,project_finish) AS effective_project_finish,
 CASE WHEN report_start IS NOT NULL AND report_finish IS NOT NULL THEN report_start||'_to_'||report_finish END AS reporting_period FROM metadata""", "metadata"))
def i05(spark, sf):
    return op.metadata_records(metadata_cells(spark, sf)).select("file", "effective_project_finish", "reporting_period")


REGISTRY_SQL = """SELECT 'p'||k AS internal_project_id, 'S-'||k AS project_sap_id, 'C-'||k AS project_code, 'Project '||k AS project_name FROM (SELECT s_suppkey AS k FROM supplier) WHERE k%2=0
 UNION ALL SELECT 'p'||k, NULL, NULL, 'PROJECT  '||k FROM (SELECT s_suppkey AS k FROM supplier) WHERE k%10=1
 UNION ALL SELECT 'd'||k, 's-'||k, 'D-'||k, 'Copy '||k FROM (SELECT s_suppkey AS k FROM supplier) WHERE k%20=4"""
INCOMING_SQL = """SELECT k AS incoming_id, CASE k%5 WHEN 1 THEN NULL WHEN 2 THEN ' s-'||k||' ' WHEN 3 THEN 'S-'||(k+1) ELSE 'S-'||k END AS project_sap_id,
 CASE k%7 WHEN 1 THEN NULL WHEN 2 THEN 'c-'||k WHEN 3 THEN 'C-'||(k+2) WHEN 4 THEN 'N-'||k ELSE 'C-'||k END AS project_code, 'Project '||k AS project_name,
 CASE WHEN k%17<>0 THEN '2024-01-01_to_2024-01-31' END AS reporting_period FROM (SELECT s_suppkey AS k FROM supplier)"""
b.define("registry", REGISTRY_SQL)
b.define("incoming", INCOMING_SQL)


def registry_rows(spark, sf):
    """Registered projects: every second supplier, some without identifiers, some repeating a SAP id."""
    k, names = C("s_suppkey"), ("internal_project_id", "project_sap_id", "project_code", "project_name")

    def row(there, *prefixes):
        return F.when(there, F.struct(*[
            (F.concat(F.lit(p), k.cast("string")) if p else F.lit(None).cast("string")).alias(n) for p, n in zip(prefixes, names, strict=True)]))

    rows = F.array(row(k % 2 == 0, "p", "S-", "C-", "Project "), row(k % 10 == 1, "p", None, None, "PROJECT  "), row(k % 20 == 4, "d", "s-", "D-", "Copy "))
    return b.table(spark, sf, "supplier").select(F.inline(F.array_compact(rows)))


def incoming_rows(spark, sf):
    k = C("s_suppkey")

    def t(prefix, v=k):
        return F.concat(F.lit(prefix), v.cast("string"))

    sap = F.when(k % 5 == 1, None).when(k % 5 == 2, F.concat(t(" s-"), F.lit(" "))).when(k % 5 == 3, t("S-", k + 1)).otherwise(t("S-"))
    code = F.when(k % 7 == 1, None).when(k % 7 == 2, t("c-")).when(k % 7 == 3, t("C-", k + 2)).when(k % 7 == 4, t("N-")).otherwise(t("C-"))
    return b.table(spark, sf, "supplier").select(
        k.alias("incoming_id"), sap.alias("project_sap_id"), code.alias("project_code"), t("Project ").alias("project_name"),
        F.when(k % 17 != 0, "2024-01-01_to_2024-01-31").alias("reporting_period"))


b.define("looked", """SELECT i.*, sn, cn, CASE WHEN sn=1 THEN sid END AS sap_project, CASE WHEN cn=1 THEN cid END AS code_project, lower(trim(coalesce(project_sap_id,''))) AS sk,
 lower(trim(coalesce(project_code,''))) AS ck, EXISTS (SELECT 1 FROM registry r WHERE r.project_sap_id IS NULL AND r.project_code IS NULL AND lower(regexp_replace(r.project_name,'\\s+',' ','g'))=lower(i.project_name)) AS legacy
 FROM incoming i LEFT JOIN (SELECT lower(project_sap_id) AS s, count(*) AS sn, min(internal_project_id) AS sid FROM registry WHERE project_sap_id IS NOT NULL GROUP BY 1) a ON a.s=lower(trim(i.project_sap_id))
 LEFT JOIN (SELECT lower(project_code) AS c, count(*) AS cn, min(internal_project_id) AS cid FROM registry WHERE project_code IS NOT NULL GROUP BY 1) d ON d.c=lower(trim(i.project_code))""", "registry", "incoming")
b.define("keyed", """SELECT *, CASE WHEN sn>1 OR cn>1 THEN 'conflict' WHEN sk='' AND ck='' THEN 'unresolved'
 WHEN sk<>'' AND ck<>'' THEN CASE WHEN sap_project=code_project THEN 'existing' WHEN sap_project IS NULL AND code_project IS NULL THEN 'new' ELSE 'conflict' END
 WHEN coalesce(sap_project,code_project) IS NOT NULL THEN 'existing' ELSE 'new' END AS key_status FROM looked""", "looked")


def resolved(spark, sf):
    return op.resolve(incoming_rows(spark, sf), registry_rows(spark, sf))


@query("i06_two_key_resolution", sql_with("""
SELECT incoming_id, key_status, CASE WHEN key_status='existing' AND reporting_period IS NOT NULL THEN coalesce(sap_project,code_project) END AS matched_project FROM keyed""", "keyed"))
def i06(spark, sf):
    return resolved(spark, sf).select("incoming_id", "key_status", "matched_project")


@query("i07_name_and_period_guard", sql_with("""
SELECT incoming_id, CASE WHEN key_status='new' AND legacy THEN 'unresolved' WHEN key_status IN ('existing','new') AND reporting_period IS NULL THEN 'unresolved' ELSE key_status END AS status FROM keyed""", "keyed"))
def i07(spark, sf):
    return resolved(spark, sf).select("incoming_id", "status")


@query("i08_unique_namespace", """
SELECT c_custkey, base_id, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE 'supplier-'||s_suppkey=base_id) THEN base_id||'-'||substr(sha256('s '||c_custkey||'|c-'||c_custkey),1,8) ELSE base_id END AS project_id
FROM (SELECT c_custkey, 'supplier-'||(c_custkey%3000) AS base_id FROM customer)""")
def i08(spark, sf):
    inc = b.table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("Supplier # "), (C("c_custkey") % 3000).cast("string")).alias("project_name"),
        F.concat(F.lit("S  "), C("c_custkey").cast("string")).alias("project_sap_id"),
        F.concat(F.lit("C-"), C("c_custkey").cast("string")).alias("project_code"))
    reg = b.table(spark, sf, "supplier").select(F.concat(F.lit("supplier-"), C("s_suppkey").cast("string")).alias("internal_project_id"))
    return op.namespaces(inc, reg).select("c_custkey", "base_id", "project_id")


@query("i09_registry_overlays", sql_with("""
SELECT internal_project_id, CASE WHEN mapped AND m_sap IS NOT NULL THEN m_sap ELSE project_sap_id END AS project_sap_id, coalesce(m_code,project_code) AS project_code, project_name,
 CASE WHEN mapped THEN 'controlled_legacy_migration' ELSE source END AS source FROM (SELECT *, 'metadata_sheet' AS source FROM registry UNION ALL
 SELECT 'p'||c_custkey, NULL, 'X-'||c_custkey, c_name, 'legacy_generated_data' FROM customer WHERE 'p'||c_custkey NOT IN (SELECT internal_project_id FROM registry)) r
LEFT JOIN (SELECT 'p'||p_partkey AS id, 'M-'||p_partkey AS m_sap, CASE WHEN p_size%2=0 THEN 'K-'||p_partkey END AS m_code, true AS mapped FROM part WHERE p_type='PROMO') m ON m.id=r.internal_project_id""", "registry"))
def i09(spark, sf):
    def t(prefix, col):
        return F.concat(F.lit(prefix), C(col).cast("string"))

    latest = b.table(spark, sf, "customer").select(
        t("p", "c_custkey").alias("internal_project_id"), F.lit(None).cast("string").alias("project_sap_id"),
        t("X-", "c_custkey").alias("project_code"), C("c_name").alias("project_name"))
    migration = b.table(spark, sf, "part").filter("p_type = 'PROMO'").select(
        t("p", "p_partkey").alias("internal_project_id"), t("M-", "p_partkey").alias("project_sap_id"),
        F.when(C("p_size") % 2 == 0, t("K-", "p_partkey")).alias("project_code"))
    return op.load_registry(registry_rows(spark, sf), latest, migration)


@query("i10_conflict_register", f"""
SELECT fingerprint, {STAMP} AS detected_at, detections, user_id, event_type, value FROM (SELECT sha256(props) AS fingerprint, ts, user_id, event_type, value,
 count(*) OVER (PARTITION BY props) AS detections FROM events QUALIFY row_number() OVER (PARTITION BY props ORDER BY ts DESC, user_id DESC, event_type DESC, value DESC)=1)""")
def i10(spark, sf):
    problems = b.table(spark, sf, "events").select(F.sha2("props", 256).alias("fingerprint"), C("ts").alias("detected_at"), "user_id", "event_type", "value")
    return op.conflict_register(problems).withColumn("detected_at", stamp("detected_at"))


@query("i11_change_history", f"""
SELECT project, {STAMP} AS changed_at, previous, event_type AS current FROM (SELECT user_id%20 AS project, ts, event_type,
 lag(event_type) OVER (PARTITION BY user_id%20 ORDER BY ts, event_id) AS previous FROM events) WHERE previous IS NULL OR previous<>event_type""")
def i11(spark, sf):
    e = b.table(spark, sf, "events").select((C("user_id") % 20).alias("project"), "ts", "event_id", "event_type")
    hist = op.change_history(e, "project", ["ts", "event_id"], "event_type", F.date_format("ts", "yyyy-MM-dd HH"))
    return hist.select("project", stamp("ts").alias("changed_at"), "previous", C("event_type").alias("current"))
