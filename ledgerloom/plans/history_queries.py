"""Registered history, hash and gate queries."""

from pyspark.sql import functions as F

from ledgerloom.operators import history as op
from ledgerloom.plans import bindings as b
from ledgerloom.plans.bindings import sql_with
from ledgerloom.plans.identity_queries import STAMP, stamp
from ledgerloom.plans.registry import query
from ledgerloom.session import written

C = F.col
b.define("revisions", """SELECT user_id%20 AS project, CASE WHEN event_id%997=0 THEN 'unknown' ELSE strftime(ts,'%Y-%m-%d') END AS period, sha256(props||user_id) AS fingerprint, ts AS processed_at,
 event_type, user_id, value FROM events""")


def revisions(spark, sf, events=None):
    """Processed source revisions; now and then a period could not be read."""
    e = events if events is not None else b.table(spark, sf, "events")
    return e.select(
        (C("user_id") % 20).alias("project"),
        F.when(C("event_id") % 997 == 0, "unknown").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("period"),
        F.sha2(F.concat(C("props"), C("user_id").cast("string")), 256).alias("fingerprint"), C("ts").alias("processed_at"), "event_type", "user_id", "value")


@query("h01_file_fingerprint", "SELECT doc_id, sha256(text) AS fingerprint FROM documents")
def h01(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", F.sha2(C("text").cast("binary"), 256).alias("fingerprint"))


def book_cells(spark, sf):
    """One workbook holding the part and the supplier table, row = key + 2."""
    num, txt = F.lit(None).cast("double"), F.lit(None).cast("string")

    def cells(t, file, sheet, key, cols):
        items = [F.struct(F.lit(i).alias("col"), (txt if isnum else C(c)).alias("value_str"),
                          (C(c).cast("double") if isnum else num).alias("value_num")) for i, (c, isnum) in enumerate(cols, 1)]
        return b.table(spark, sf, t).select(F.lit(file).alias("file"), F.lit(sheet).alias("sheet"),
                                            (C(key) + 2).cast("int").alias("row"), F.inline(F.array(*items)))

    return cells("part", "book", "part", "p_partkey", [
        ("p_partkey", True), ("p_name", False), ("p_brand", False), ("p_type", False), ("p_size", True), ("p_retailprice", True)]
    ).unionByName(cells("supplier", "book", "supplier", "s_suppkey", [("s_suppkey", True), ("s_name", False), ("s_acctbal", True)]))


b.define("book", """SELECT 'book' AS file, 'part' AS sheet, p_partkey+2 AS row, v.* FROM part, LATERAL (VALUES (1,NULL,p_partkey::DOUBLE),(2,p_name,NULL),(3,p_brand,NULL),(4,p_type,NULL),
 (5,NULL,p_size::DOUBLE),(6,NULL,p_retailprice)) v(col,value_str,value_num)
 UNION ALL SELECT 'book', 'supplier', s_suppkey+2, v.* FROM supplier, LATERAL (VALUES (1,NULL,s_suppkey::DOUBLE),(2,s_name,NULL),(3,NULL,s_acctbal)) v(col,value_str,value_num)""")
SEMANTIC_SQL = """
SELECT file, sha256(string_agg(sheet||'|'||h,chr(10) ORDER BY sheet)) AS content_sha256 FROM (
 SELECT file, sheet, sha256(string_agg(h,chr(10) ORDER BY b2)) AS h FROM (
  SELECT file, sheet, b2, sha256(string_agg(h,chr(10) ORDER BY b1)) AS h FROM (
   SELECT file, sheet, b1, b1//256 AS b2, sha256(string_agg(row||'|'||h,chr(10) ORDER BY row)) AS h FROM (
    SELECT file, sheet, row, row//256 AS b1, sha256(string_agg(col||'|'||coalesce(value_str,printf('%.6f',value_num),'')||'|',chr(10) ORDER BY col)) AS h FROM book GROUP BY file, sheet, row)
   GROUP BY file, sheet, b1, b1//256) GROUP BY file, sheet, b2) GROUP BY file, sheet) GROUP BY file"""


@query("h02_semantic_fingerprint", sql_with(SEMANTIC_SQL, "book"))
def h02(spark, sf):
    cells = book_cells(spark, sf).withColumn("formula", F.lit(None).cast("string"))
    return op.semantic_fingerprint(cells)


@query("h03_reference_match", """
SELECT doc_id, CASE WHEN e IS NULL AND s IS NULL THEN NULL ELSE least(coalesce(e,s),coalesce(s,e)) END AS entry,
 CASE WHEN e IS NOT NULL AND e<=coalesce(s,e) THEN 'exact_file_sha256' WHEN s IS NOT NULL THEN 'semantic_workbook_sha256' END AS match_mode FROM
(SELECT d.doc_id, (SELECT min(doc_id) FROM documents x JOIN labels USING (doc_id) WHERE sha256(x.text)=sha256(d.text)) AS e,
 (SELECT min(doc_id) FROM documents x JOIN labels USING (doc_id) WHERE sha256(lower(x.text))=sha256(lower(d.text))) AS s FROM documents d)""")
def h03(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"), F.sha2(F.lower("text"), 256).alias("content_sha256"))
    approved = b.table(spark, sf, "labels").select("doc_id").distinct()
    index = d.join(approved, "doc_id", "left_semi").select(C("doc_id").alias("entry"), C("fingerprint").alias("source_sha256"), "content_sha256")
    return op.match_reference(d, index).select("doc_id", "entry", "match_mode")


@query("h04_incremental_skip", """
WITH f AS (SELECT user_id AS path, event_type AS stat, sha256(props) AS sha FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC)=1),
 s AS (SELECT user_id AS path, event_type AS stat, sha256(props) AS sha FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts)=1)
SELECT f.path, CASE WHEN f.stat=s.stat THEN 'unchanged' WHEN f.sha IN (SELECT sha FROM s) THEN 'duplicate' ELSE 'process' END AS status FROM f LEFT JOIN s ON s.path=f.path""")
def h04(spark, sf):
    e = b.table(spark, sf, "events")
    rec = F.struct(C("event_type").alias("stat"), F.sha2("props", 256).alias("sha256"))
    files = e.groupBy(C("user_id").alias("path")).agg(F.max_by(rec, "ts").alias("r")).select("path", "r.*")
    state = e.groupBy(C("user_id").alias("path")).agg(F.min_by(rec, "ts").alias("r")).select("path", "r.*")
    return op.incremental_status(files, state)


@query("h05_restore_report", sql_with("""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN fingerprint IN (SELECT fingerprint FROM revisions WHERE substr(sha256(project||period),1,1) IN ('0','2','4','6','8','a','c','e')) THEN 'present' WHEN event_type='error' THEN 'failed'
 WHEN value<1 THEN 'blocked' ELSE 'restored' END AS status FROM revisions) GROUP BY status""", "revisions"))
def h05(spark, sf):
    r = revisions(spark, sf)
    sources = r.select("fingerprint", (C("event_type") == "error").alias("failed"), (C("value") < 1).alias("blocked"))
    return op.restore_report(sources, r.filter(known()))


@query("h06_revision_store", sql_with(f"""
SELECT project, period, fingerprint, {STAMP.replace('ts,', 'p,')} AS processed_at, rn=1 AS is_latest FROM (SELECT *, row_number() OVER (PARTITION BY project, period ORDER BY p DESC, fingerprint DESC) AS rn
 FROM (SELECT project, period, fingerprint, max(processed_at) AS p FROM revisions GROUP BY 1,2,3))""", "revisions"))
def h06(spark, sf):
    return op.revision_store(revisions(spark, sf)).withColumn("processed_at", stamp("processed_at"))


LATEST_SQL = f"""
SELECT r.project, arg_max(period,(period,processed_at)) AS period, arg_max(fingerprint,(period,processed_at)) AS fingerprint, strftime(arg_max(processed_at,(period,processed_at)),'%Y-%m-%d %H:%M:%S.%f') AS processed_at
FROM (SELECT r.project, CASE WHEN r.period='unknown' THEN '' ELSE r.period END AS period, r.fingerprint, r.processed_at FROM revisions r LEFT JOIN (SELECT project, max(processed_at) AS u FROM revisions WHERE period='unknown' GROUP BY 1) x
 ON x.project=r.project WHERE x.u IS NULL OR r.processed_at>=x.u) r GROUP BY r.project"""


@query("h07_latest_per_project", sql_with(
    "SELECT project, CASE WHEN period='' THEN 'unknown' ELSE period END AS period, fingerprint, processed_at FROM (" + LATEST_SQL + ")", "revisions"))
def h07(spark, sf):
    return op.latest_per_project(revisions(spark, sf)).withColumn("processed_at", stamp("processed_at"))


@query("h08_registry_rebuild", sql_with("""
SELECT project, max(month) AS reporting_period, count(*) AS history_rows, arg_max(ev,month) AS earned_value, arg_max(ac,month) AS actual_cost,
 arg_max(CASE WHEN ac<>0 THEN ev/ac END,month) AS cpi, arg_max(ev-ac,month) AS cost_variance, min(month) AS first_period, string_agg(month,',' ORDER BY month) AS periods FROM project_months GROUP BY project""", "project_months"))
def h08(spark, sf):
    m = b.project_months(spark, sf)
    entry = F.struct("month", "ev", "ac")
    # the history stays the long table; only the month names, bounded by the calendar, are joined into a text
    reg = m.groupBy("project").agg(F.max(entry).alias("last"), F.count("*").alias("history_rows"), F.min("month").alias("first_period"), F.sort_array(F.collect_list("month")).alias("months"))
    ev, ac = C("last.ev"), C("last.ac")
    return reg.select(
        "project", C("last.month").alias("reporting_period"), "history_rows", ev.alias("earned_value"), ac.alias("actual_cost"),
        F.when(ac != 0, ev / ac).alias("cpi"), (ev - ac).alias("cost_variance"), "first_period", F.array_join("months", ",").alias("periods"))


@query("h09_registry_fingerprint", """
WITH l AS (SELECT substr(sha256(k),1,4) AS leaf, count(*) AS n, sha256(string_agg(t,chr(10) ORDER BY k)) AS h FROM
 (SELECT c_name AS k, c_name||'|'||c_mktsegment||'|'||c_nationkey AS t FROM customer) GROUP BY 1),
 br AS (SELECT substr(leaf,1,2) AS branch, sum(n) AS n, sha256(string_agg(h,chr(10) ORDER BY leaf)) AS h FROM l GROUP BY 1)
SELECT sha256(string_agg(h,chr(10) ORDER BY branch)) AS registry_fingerprint, CAST(sum(n) AS BIGINT) AS project_count FROM br""")
def h09(spark, sf):
    payload = F.concat_ws("|", "c_name", "c_mktsegment", C("c_nationkey").cast("string"))
    return op.registry_hash(b.table(spark, sf, "customer"), "c_name", payload)


b.define("hist", """SELECT project, period, max(fingerprint) AS fingerprint, max(processed_at) AS processed_at FROM revisions
 WHERE substr(sha256(project||period),1,1) IN ('0','2','4','6','8','a','c','e') GROUP BY 1,2""", "revisions")


def known():
    return F.substring(F.sha2(F.concat("project", "period"), 256), 1, 1).isin(*"02468ace")


def history_rows(spark, sf):
    """Already published history: one revision of about half the project periods, over the whole time range (an even hash digit)."""
    r = revisions(spark, sf).filter(known())
    return r.groupBy("project", "period").agg(F.max("fingerprint").alias("fingerprint"), F.max("processed_at").alias("processed_at"))


@query("h10_change_classification", sql_with("""
SELECT project, period, user_id, CASE WHEN fingerprint IN (SELECT fingerprint FROM hist) THEN 'unchanged' WHEN status='conflict' THEN 'blocked' WHEN status='new' THEN 'create'
 WHEN EXISTS (SELECT 1 FROM hist h WHERE h.project=c.project AND h.period=c.period) THEN 'update_same_period' WHEN c.period<cur THEN 'restore_older' WHEN c.period>cur THEN 'update_newer' ELSE 'update_new_period' END AS classification
 FROM (SELECT r.project, period, user_id, fingerprint, CASE event_type WHEN 'error' THEN 'conflict' WHEN 'click' THEN 'new' ELSE 'existing' END AS status, cur FROM revisions r
 LEFT JOIN (SELECT project, max(period) AS cur FROM hist GROUP BY 1) m ON m.project=r.project) c""", "hist"))
def h10(spark, sf):
    cand = revisions(spark, sf).select("project", "period", "user_id", "fingerprint", F.when(C("event_type") == "error", "conflict").when(
        C("event_type") == "click", "new").otherwise("existing").alias("identity_status"))
    return op.classify_change(cand, history_rows(spark, sf)).drop("fingerprint", "identity_status")


@query("h11_index_consistency", sql_with("""
SELECT project, period, fingerprint, 'registry:extra' AS finding FROM (SELECT project, period, fingerprint FROM revisions EXCEPT ALL SELECT project, period, fingerprint FROM hist)
UNION ALL SELECT project, period, fingerprint, 'registry:missing' FROM (SELECT project, period, fingerprint FROM hist EXCEPT ALL SELECT project, period, fingerprint FROM revisions)""", "hist"))
def h11(spark, sf):
    cols = ["project", "period", "fingerprint"]
    return op.index_differences(revisions(spark, sf).select(*cols), history_rows(spark, sf).select(*cols), "registry")


@query("h12_delta_plan", """
SELECT coalesce(l.path,r.path) AS path, CASE WHEN l.path IS NULL THEN 'remote_only' WHEN r.path IS NULL THEN 'NEW' WHEN l.sha=r.sha THEN 'unchanged' ELSE 'UPDATE' END AS kind FROM
(SELECT doc_id AS path, sha256(text) AS sha FROM documents) l FULL JOIN (SELECT d.doc_id+100 AS path, sha256(CASE WHEN (d.doc_id+100)%3=0 THEN d.text ELSE e.text END) AS sha FROM documents d
 LEFT JOIN documents e ON e.doc_id=d.doc_id+100) r ON r.path=l.path""")
def h12(spark, sf):
    d = b.table(spark, sf, "documents").select("doc_id", "text")
    local = d.select(C("doc_id").alias("path"), F.sha2("text", 256).alias("sha"))
    # Remote copy: paths shifted by 100, every third one holding another document's text.
    other = d.select((C("doc_id") - 100).alias("doc_id"), C("text").alias("same"))
    remote = d.join(other, "doc_id", "left").select(
        (C("doc_id") + 100).alias("path"),
        F.sha2(F.when((C("doc_id") + 100) % 3 == 0, C("text")).otherwise(C("same")), 256).alias("sha"))
    return op.delta_plan(local, remote)


@query("h13_chronology", sql_with("""
SELECT l.project, l.period, l.period=m.mp AND EXISTS (SELECT 1 FROM hist h WHERE h.project=l.project AND h.period=l.period AND h.fingerprint=l.fingerprint) AS ok FROM
(SELECT project, max(period) AS period, arg_max(fingerprint,(period,processed_at)) AS fingerprint FROM hist WHERE project%3<>0 OR period<'2024-01-10' GROUP BY 1) l
LEFT JOIN (SELECT project, max(period) AS mp FROM hist GROUP BY 1) m ON m.project=l.project""", "hist"))
def h13(spark, sf):
    h = history_rows(spark, sf)
    stale = h.filter("project % 3 <> 0 OR period < '2024-01-10'").groupBy("project").agg(
        F.max_by(F.struct("period", "fingerprint"), F.struct("period", "processed_at")).alias("l")).select("project", "l.*")
    return op.chronology(stale, h)


def isolation_gate(registry, summaries, sheets):
    """Assertion rows: duplicate ids or keys, missing identity, sheet counts and foreign or stale sheets.

    Each table is read once: the registry's ids and keys are counted together, the sheets of a project fold to a count and the
    least and greatest fingerprint, and a joined row gives all its findings. A sheet finding stands once per project.
    """
    keys = registry.select(C("project"), F.inline(F.array(
        F.struct(F.lit("duplicate_project_id").alias("error"), C("project").cast("string").alias("key")),
        F.struct(F.lit("duplicate_key").alias("error"), C("sap_key").cast("string").alias("key")))))
    twice = keys.filter("error = 'duplicate_project_id' OR key IS NOT NULL").groupBy("error", "key").agg(
        F.count("*").alias("k"), F.min("project").alias("project")).filter("k > 1").select("project", "error")
    folded = sheets.groupBy("project").agg(F.count("*").alias("listed"), F.min("sheet_fingerprint").alias("lo"), F.max("sheet_fingerprint").alias("hi"))
    j = summaries.withColumn("told", F.lit(True)).join(folded, "project", "full_outer")
    stale = C("listed").isNotNull() & (C("fingerprint").isNull() | (C("lo") != C("fingerprint")) | (C("hi") != C("fingerprint")))
    checks = {
        "identity_missing": C("told") & C("sap_key").isNull() & C("code_key").isNull(),
        "sheet_count_mismatch": C("told") & (C("sheet_count") != F.coalesce("listed", F.lit(0))),
        "sheet_fingerprint_mismatch": stale, "unaccounted_sheets": C("told") & (C("unaccounted") > 0)}
    found = j.select("project", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))).alias("error"))
    counted = found.groupBy("project", "error").agg(F.count("*").cast("int").alias("k"))
    times = F.when(C("error") == "sheet_fingerprint_mismatch", 1).otherwise(C("k"))
    return twice.unionByName(counted.select("project", "error", F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_"))


b.define("summaries", """SELECT c_custkey AS project, CASE WHEN c_custkey%9<>0 THEN 'K'||(c_custkey//2*2) END AS sap_key, CASE WHEN c_custkey%5<>0 THEN 'C'||c_custkey END AS code_key,
 CASE WHEN c_custkey%7=0 THEN n+1 ELSE n END AS sheet_count, fp AS fingerprint, c_custkey%50 AS unaccounted FROM customer JOIN (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS fp FROM orders GROUP BY 1) ON o_custkey=c_custkey""")


def summaries(spark, sf):
    o = b.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("fingerprint"))
    k = C("c_custkey")
    return b.table(spark, sf, "customer").join(o, k == C("o_custkey")).select(
        k.alias("project"), F.when(k % 9 != 0, F.concat(F.lit("K"), (F.floor(k / 2) * 2).cast("string"))).alias("sap_key"),
        F.when(k % 5 != 0, F.concat(F.lit("C"), k.cast("string"))).alias("code_key"),
        F.when(k % 7 == 0, C("n") + 1).otherwise(C("n")).alias("sheet_count"), "fingerprint", (k % 50).alias("unaccounted"))


@query("h14_isolation_gate", sql_with("""
SELECT min(project) AS project, 'duplicate_key' AS error FROM summaries WHERE sap_key IS NOT NULL GROUP BY sap_key HAVING count(*)>1
UNION ALL SELECT project, 'identity_missing' FROM summaries WHERE sap_key IS NULL AND code_key IS NULL
UNION ALL SELECT s.project, 'sheet_count_mismatch' FROM summaries s JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey=project WHERE sheet_count<>n
UNION ALL SELECT DISTINCT project, 'sheet_fingerprint_mismatch' FROM summaries JOIN orders ON o_custkey=project WHERE o_orderpriority<>fingerprint
UNION ALL SELECT project, 'unaccounted_sheets' FROM summaries WHERE unaccounted>0""", "summaries"))
def h14(spark, sf):
    s = written(summaries(spark, sf), "summaries")
    sheets = b.table(spark, sf, "orders").select(C("o_custkey").alias("project"), C("o_orderpriority").alias("sheet_fingerprint"))
    return isolation_gate(s.select("project", "sap_key"), s, sheets)


@query("h15_completeness_gate", sql_with("""
SELECT project, CASE WHEN sheet_count<>n OR unaccounted<>0 THEN 'incomplete' WHEN sap_key IS NULL AND code_key IS NULL THEN 'no_identity' ELSE 'pass' END AS gate
FROM summaries JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey=project""", "summaries"))
def h15(spark, sf):
    listed = b.table(spark, sf, "orders").groupBy(C("o_custkey").alias("project")).agg(F.count("*").alias("listed"))
    return summaries(spark, sf).join(listed, "project").select("project", F.when(
        (C("sheet_count") != C("listed")) | (C("unaccounted") != 0), "incomplete").when(
        C("sap_key").isNull() & C("code_key").isNull(), "no_identity").otherwise("pass").alias("gate"))


@query("h16_selected_revision", sql_with("""
SELECT h.project, h.period, h.fingerprint, CASE r WHEN 2 THEN 'chosen' WHEN 1 THEN 'current' ELSE 'last' END AS basis FROM (SELECT h.*, CASE WHEN h.fingerprint=c.chosen THEN 2 WHEN h.fingerprint=c.current THEN 1 ELSE 0 END AS r
 FROM hist h JOIN (SELECT project, CASE WHEN project%3=0 THEN min(fingerprint) END AS chosen, CASE WHEN project%3=1 THEN max(fingerprint) END AS current FROM hist GROUP BY 1) c ON c.project=h.project) h
QUALIFY row_number() OVER (PARTITION BY project ORDER BY r DESC, period DESC, processed_at DESC)=1""", "hist"))
def h16(spark, sf):
    h = history_rows(spark, sf)
    choice = h.groupBy("project").agg(F.min("fingerprint").alias("lo"), F.max("fingerprint").alias("hi")).select(
        "project", F.when(C("project") % 3 == 0, C("lo")).alias("chosen"), F.when(C("project") % 3 == 1, C("hi")).alias("current"))
    return op.selected_revision(h, choice)
