"""Registered source and sink queries (S01-S12, S14) over files derived from the given tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.plans import bindings as b
from ledgerloom.plans.bindings import sql_with
from ledgerloom.plans.registry import query
from ledgerloom.sources import forms, snapshots, workbooks
from ledgerloom.streaming.watch import run_folder

C = F.col
BLOCK = 50
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PKG = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'


def _workbook(pdf: pd.DataFrame) -> bytes:
    """A small workbook: names, balances, a formula, a flag and a date per supplier, one hidden sheet, one chart."""
    names = list(pdf["s_name"])
    rows = []
    for i, (k, bal) in enumerate(zip(pdf["s_suppkey"], pdf["s_acctbal"])):
        r = int(k) % BLOCK + 2
        rows.append(
            f'<row r="{r}"><c r="A{r}" t="s"><v>{i}</v></c><c r="B{r}"><v>{float(bal)!r}</v></c><c r="C{r}"><f>B{r}*2</f><v>{float(bal) * 2!r}</v></c>'
            f'<c r="D{r}" t="b"><v>{int(k) % 2}</v></c><c r="E{r}" s="1"><v>{45000 + int(k)}</v></c><c r="F{r}" t="e"><v>#N/A</v></c><c r="G{r}"/></row>')
    sheet = f'<worksheet {MAIN}><sheetData>{"".join(rows)}</sheetData></worksheet>'
    notes = f'<worksheet {MAIN}><sheetData><row r="1"><c r="AB1" t="inlineStr"><is><t>block {int(pdf["block"].iloc[0])}</t></is></c></row></sheetData></worksheet>'
    chart = ('<c:chartSpace xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main">'
             f'<c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>Balance of block {int(pdf["block"].iloc[0])}</a:t></a:r></a:p></c:rich></c:tx></c:title>'
             '<c:plotArea><c:barChart><c:ser><c:tx><c:strRef><c:f>Data!$B$1</c:f><c:strCache><c:pt idx="0"><c:v>Balance</c:v></c:pt></c:strCache></c:strRef></c:tx>'
             '<c:val><c:numRef><c:f>Data!$B$2:$B$9</c:f></c:numRef></c:val></c:ser></c:barChart></c:plotArea></c:chart></c:chartSpace>')
    parts = {
        "xl/workbook.xml": f'<workbook {MAIN} {REL}><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Notes" sheetId="2" state="hidden" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": PKG + '<Relationship Id="rId1" Type="w" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="w" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst {MAIN}>' + "".join(f"<si><t>{escape(n)}</t></si>" for n in names) + "</sst>",
        "xl/styles.xml": f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet2.xml": notes,
        "xl/worksheets/_rels/sheet1.xml.rels": PKG + '<Relationship Id="rId1" Type="d" Target="../drawings/drawing1.xml"/></Relationships>',
        "xl/drawings/drawing1.xml": "<d/>",
        "xl/drawings/_rels/drawing1.xml.rels": PKG + '<Relationship Id="rId1" Type="c" Target="../charts/chart1.xml"/></Relationships>',
        "xl/charts/chart1.xml": chart,
    }
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buf.getvalue()


def workbook_files(spark, sf, damaged: bool = False):
    """One workbook per block of fifty suppliers; with ``damaged`` every second one is cut short."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        payload = _workbook(pdf.sort_values("s_suppkey"))
        if damaged and block % 2 == 1:
            payload = payload[: len(payload) // 2]
        return pd.DataFrame({"path": [f"/in/block-{block}.xlsx"], "content": [payload]})

    s = b.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal", F.floor(C("s_suppkey") / BLOCK).alias("block"))
    return s.groupBy("block").applyInPandas(build, "path string, content binary")


@query("s01_workbook_cells", f"""
WITH s AS (SELECT *, '/in/block-'||(s_suppkey//{BLOCK})||'.xlsx' AS path, s_suppkey%{BLOCK}+2 AS r FROM supplier)
SELECT path, 'Data' AS sheet, 'visible' AS state, v.c||r AS ref, r AS row, v.col, v.value_str, v.value_num, v.value_bool, v.formula, v.nf AS number_format, v.d AS is_date_format FROM s, LATERAL (VALUES
 ('A',1,s_name,NULL,NULL,NULL,'',false),('B',2,NULL,s_acctbal,NULL,NULL,'',false),('C',3,NULL,s_acctbal*2,NULL,'B'||r||'*2','',false),('D',4,NULL,NULL,s_suppkey%2=1,NULL,'',false),
 ('E',5,NULL,(45000+s_suppkey)::DOUBLE,NULL,NULL,'yyyy\\-mm\\-dd',true),('F',6,'#N/A',NULL,NULL,NULL,'',false)) v(c,col,value_str,value_num,value_bool,formula,nf,d)
UNION ALL SELECT DISTINCT path, 'Notes', 'hidden', 'AB1', 1, 28, 'block '||(s_suppkey//{BLOCK}), NULL, NULL, NULL, '', false FROM s""".replace("yyyy\\\\-mm\\\\-dd", "yyyy\\-mm\\-dd"))
def s01(spark, sf):
    cells = workbooks.accepted_cells(workbooks.scan_cells(workbook_files(spark, sf)))
    return cells.drop("sheet_idx").withColumn("col", C("col").cast("int"))


FORMATS = ["General", "yyyy-mm-dd", "0.00", '"day" 0.0', "[h]:mm", "#,##0 [$EGP]", "mmm-yy", "\\d0", "0%", "hh:mm:ss"]


@query("s02_date_format_detection", """
SELECT p_partkey, (p_size BETWEEN 14 AND 22) OR (p_size BETWEEN 45 AND 47) OR (p_partkey%10 IN (1,4,6,9)) AS is_date FROM part""")
def s02(spark, sf):
    code = F.element_at(F.array(*[F.lit(f) for f in FORMATS]), (C("p_partkey") % 10 + 1).cast("int"))
    return b.table(spark, sf, "part").select("p_partkey", workbooks.is_date_format(C("p_size"), code).alias("is_date"))


@query("s03_chart_inventory", f"""
SELECT DISTINCT '/in/block-'||(s_suppkey//{BLOCK})||'.xlsx' AS path, 'Data' AS sheet, 'Balance of block '||(s_suppkey//{BLOCK}) AS title, 'bar' AS chart_type, 'Balance' AS series_title,
 'Data!$B$1,Data!$B$2:$B$9' AS refs, 'Balance' AS cached FROM supplier""")
def s03(spark, sf):
    ch = workbooks.scan_charts(workbook_files(spark, sf))
    return ch.select("path", "sheet", "title", "chart_type", F.explode("series").alias("s")).select(
        "path", "sheet", "title", "chart_type", C("s.title").alias("series_title"), F.array_join("s.refs", ",").alias("refs"), F.array_join("s.cached", ",").alias("cached"))


def xml_forms(spark, sf):
    """A symbol form per customer; a few carry a foreign root element."""
    k = C("c_custkey").cast("string")
    root = F.when(C("c_custkey") % 10 == 3, "OTHER").when(C("c_custkey") % 2 == 0, "XSF").otherwise("XDF")
    ext = F.when(C("c_custkey") % 10 == 3, ".xml").when(C("c_custkey") % 2 == 0, ".xsf").otherwise(".xdf")
    body = F.concat(
        F.lit("<?xml version=\"1.0\"?>\n<"), root, F.lit("><field name=\"Project Code\"> C-"), k, F.lit(" </field><n:Empty/><ReportStart>2024-01-01</ReportStart>"),
        F.lit("<item><Code>A."), k, F.lit("</Code><Note>x &amp; y</Note><Blank> </Blank></item></"), root, F.lit(">"))
    return b.table(spark, sf, "customer").select(F.concat(F.lit("/in/f"), k, ext).alias("path"), body.alias("text"))


b.define("forms", """SELECT '/in/f'||c_custkey||CASE WHEN c_custkey%10=3 THEN '.xml' WHEN c_custkey%2=0 THEN '.xsf' ELSE '.xdf' END AS path, c_custkey AS k,
 CASE WHEN c_custkey%10=3 THEN 'OTHER' WHEN c_custkey%2=0 THEN 'XSF' ELSE 'XDF' END AS root FROM customer""")


@query("s04_xml_forms", sql_with("""
SELECT path, root, CASE WHEN root='OTHER' THEN 'Unsupported XML input: root must be XSF or XDF' END AS error, ordinal, name, value, record FROM forms, LATERAL (VALUES (1,'Project Code','C-'||k),(2,'ReportStart','2024-01-01'),
 (3,'Code','A.'||k),(4,'Note','x & y')) v(ordinal,name,value), LATERAL (SELECT 'Code,A.'||k||',Note,x & y,Blank,' AS record) r""", "forms"))
def s04(spark, sf):
    src = xml_forms(spark, sf)
    pairs, recs, roots = forms.xml_pairs(src), forms.xml_records(src), forms.valid_forms(src)
    return pairs.join(recs.select("path", F.array_join("record", ",").alias("record")), "path").join(roots, "path").withColumn("ordinal", C("ordinal") + 1)


@query("s05_xml_envelope", sql_with("""
SELECT path, sheet, state, ref, row, col, value_str, value_num, meta FROM forms, LATERAL (VALUES ('Costs','visible','A1',1,1,'Budget',NULL::DOUBLE),('Costs','visible','B1',1,2,NULL,k+0.5::DOUBLE),('Sheet 2','hidden','AA10',10,27,'n'||k,NULL)) v(sheet,state,ref,row,col,value_str,value_num),
 LATERAL (SELECT 'ProjectCode=C-'||k AS meta) m""", "forms"))
def s05(spark, sf):
    k = C("k").cast("string")
    src = xml_forms(spark, sf).select("path", F.regexp_extract("path", r"f(\d+)\.", 1).alias("k")).select("path", F.concat(
        F.lit("<XDF><METADATA><ProjectCode>C-"), k, F.lit("</ProjectCode></METADATA><WORKBOOK><SHEET name='Costs'><C ref='a1'>Budget</C><C ref=\"B1\">"), k,
        F.lit(".5</C><C ref='??'>5</C></SHEET><SHEET state='hidden'><R><C ref='AA10' x='1'>n"), k, F.lit("</C><C ref='B2'> </C></R></SHEET></WORKBOOK></XDF>")).alias("text"))
    meta = forms.envelope_pairs(src).select("path", F.concat_ws("=", "name", "value").alias("meta"))
    return forms.envelope_cells(src).join(meta, "path").drop("sheet_idx")


@query("s06_html_fields", r"""
SELECT page_id, name, value, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, v.name, v.value FROM pages, LATERAL (VALUES ('project-code','P-'||page_id),('og:title',url),('Budget','5 & 6'),('sap','S'||page_id),('Label','Value'),('only',page_id||'')) v(name,value)) GROUP BY ALL""")
def s06(spark, sf):
    k = C("page_id").cast("string")
    block = F.concat(
        F.lit("<meta name=\"project-code\" content=\"P-"), k, F.lit("\"><meta property='og:title' content='"), C("url"), F.lit("'><input type=\"text\" id=\"Budget\" value=\"5 &amp; 6\">"),
        F.lit("<input name=\"empty\" value=\"\"><span class=\"f\" data-field=\"sap\" data-value=\"S"), k, F.lit("\">.</span><table><tr><th>Label</th><td> Value </td></tr><tr><td></td></tr><tr><td>only</td><td><b>"), k,
        F.lit("</b></td><td>z</td></tr></table>"))
    src = b.table(spark, sf, "pages").select("page_id", F.concat(C("html"), block).alias("text")).withColumnRenamed("page_id", "path")
    return forms.html_fields(src).groupBy(C("path").alias("page_id"), "name", "value").agg(F.count("*").alias("n"))


TEXT_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text,chr(10))) AS raw, generate_subscripts(string_split(text,chr(10)),1)-1 AS line FROM documents),
 t AS (SELECT doc_id, line, trim(regexp_replace(regexp_replace(raw,'[\p{C}\p{Z}]',' ','g'),'\s+',' ','g')) AS t FROM l)
SELECT doc_id, line, CASE WHEN m THEN trim(regexp_extract(t,'^(.{2,80}?)(?:\s*[:=|\t]\s*|\s{2,})(.+)$',1)) END AS label,
 CASE WHEN m THEN trim(regexp_extract(t,'^(.{2,80}?)(?:\s*[:=|\t]\s*|\s{2,})(.+)$',2)) ELSE t END AS value FROM (SELECT *, regexp_matches(t,'^(.{2,80}?)(?:\s*[:=|\t]\s*|\s{2,})(.+)$') AS m FROM t) WHERE t<>''"""


@query("s07_text_records", TEXT_SQL)
def s07(spark, sf):
    src = b.table(spark, sf, "documents").select(C("doc_id").alias("path"), "text")
    return forms.text_records(src).select(C("path").alias("doc_id"), C("line").cast("long").alias("line"), "label", "value")


@query("s08_text_decoding", r"""
SELECT doc_id, CASE doc_id%4 WHEN 3 THEN regexp_replace(text,'[^\x00-\x7F\x{A0}-\x{FF}]','?','g') ELSE text END AS text FROM documents""")
def s08(spark, sf):
    t = C("text")
    narrow = F.regexp_replace(t, r"[^\x00-\x7F\x{A0}-\x{FF}]", "?")
    content = (F.when(C("doc_id") % 4 == 0, F.encode(t, "UTF-8")).when(C("doc_id") % 4 == 1, F.encode(F.concat(F.lit("﻿"), t), "UTF-8"))
               .when(C("doc_id") % 4 == 2, F.encode(t, "UTF-16")).otherwise(F.encode(narrow, "ISO-8859-1")))
    files = b.table(spark, sf, "documents").select(C("doc_id").alias("path"), content.alias("content"))
    return forms.source_text(files).withColumnRenamed("path", "doc_id")


@query("s09_metadata_labels", """
SELECT s_suppkey AS path, display, value, position FROM supplier, LATERAL (VALUES ('project sap id','S'||s_suppkey,1),('project code',CASE WHEN s_suppkey%2=0 THEN 'first' ELSE 'second' END,2),('project name',s_name,3),('project finish-EOT','2026',8)) v(display,value,position)""")
def s09(spark, sf):
    k = C("s_suppkey").cast("string")
    pairs = [("Sap_ProjectId", F.concat(F.lit("S"), k)), ("ProjectCode", F.when(C("s_suppkey") % 2 == 0, "first").otherwise(" ")), ("project.code", F.lit("second")),
             ("My Main Project-Name", C("s_name")), ("Owner", F.lit("x")), ("PROJECT FINISH EOT", F.lit("2026"))]
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("name"), v.alias("value")) for i, (n, v) in enumerate(pairs)])
    return forms.metadata_rows(b.table(spark, sf, "supplier").select(C("s_suppkey").alias("path"), F.inline(rows)))


@query("s10_source_discovery", """
SELECT min(path) AS path FROM (SELECT CASE WHEN o_orderkey%3=0 THEN '/In/Folder/' ELSE '/in/folder/' END||CASE WHEN o_orderkey%7=0 THEN '~$' ELSE '' END||'file'||(o_orderkey//2)||
 CASE o_orderkey//2%5 WHEN 0 THEN '.xlsx' WHEN 1 THEN '.XLSM' WHEN 2 THEN '.pdf' WHEN 3 THEN '.htm' ELSE '.xsf' END AS path FROM orders) WHERE NOT contains(path,'~$') AND NOT path LIKE '%.pdf' GROUP BY lower(path)""")
def s10(spark, sf):
    k, half = C("o_orderkey"), F.floor(C("o_orderkey") / 2)
    ext = F.element_at(F.array(*[F.lit(e) for e in (".xlsx", ".XLSM", ".pdf", ".htm", ".xsf")]), (half % 5 + 1).cast("int"))
    path = F.concat(F.when(k % 3 == 0, "/In/Folder/").otherwise("/in/folder/"), F.when(k % 7 == 0, "~$").otherwise(""), F.lit("file"), half.cast("string"), ext)
    files = b.table(spark, sf, "orders").select(path.alias("path"), k.alias("length"))
    return workbooks.source_files(files).select("path")


@query("s11_snapshot_json", """
SELECT c_custkey, 'p'||c_custkey AS project_id, c_name AS project_name, 'C-'||c_custkey AS project_code, CASE WHEN c_custkey%3<>0 THEN c_acctbal END AS budget, c_custkey%2=0 AS has_ledger, 3 AS sheet_count FROM customer WHERE c_custkey%10<>4""")
def s11(spark, sf):
    k = C("c_custkey").cast("string")
    good = F.to_json(F.struct(
        F.lit(3).alias("schema_version"), F.concat(F.lit("p"), k).alias("project_id"), C("c_name").alias("project_name"),
        F.struct(F.concat(F.lit("C-"), k).alias("project_code")).alias("identity"),
        F.when(C("c_custkey") % 3 != 0, F.create_map(F.lit("budget"), F.struct(F.struct(C("c_acctbal").alias("value")).alias("preferred")))).alias("metrics"),
        F.create_map(F.lit("ledger"), C("c_custkey") % 2 == 0).alias("capabilities"), F.struct(F.lit(3).alias("sheet_count"), F.lit(0).alias("unaccounted_sheets")).alias("manifest")))
    text = F.when(C("c_custkey") % 10 == 4, F.substring(good, 1, 40)).otherwise(good)
    snaps = snapshots.parse_snapshots(b.table(spark, sf, "customer").select("c_custkey", text.alias("t")), "c_custkey", "t")
    return snaps.select("c_custkey", "project_id", "project_name", C("identity.project_code").alias("project_code"),
                        F.try_element_at("metrics", F.lit("budget"))["preferred"]["value"].alias("budget"),
                        F.try_element_at("capabilities", F.lit("ledger")).alias("has_ledger"), C("manifest.sheet_count").alias("sheet_count"))


@query("s12_rejected_sources", f"""
SELECT CASE WHEN s_suppkey//{BLOCK}%2=1 THEN 'rejected' ELSE 'read' END AS status, count(DISTINCT s_suppkey//{BLOCK}) AS n FROM supplier GROUP BY 1""")
def s12(spark, sf):
    return workbooks.readings(workbooks.scan_cells(workbook_files(spark, sf, damaged=True)))


@query("s14_namespaced_sink", sql_with("""
SELECT project AS project_id, substr(month,1,4) AS period, month, sha256(project||'|'||month) AS fingerprint, bac, ev, ac FROM project_months""", "project_months"))
def s14(spark, sf):
    folder = run_folder(spark, "namespaced")
    m = b.project_months(spark, sf).select(
        C("project").alias("project_id"), F.substring("month", 1, 4).alias("period"), "month", F.sha2(F.concat_ws("|", "project", "month"), 256).alias("fingerprint"),
        "bac", "ev", "ac")
    snapshots.write_namespaced(m, folder, ("project_id", "period"))
    return spark.read.parquet(folder).withColumn("period", C("period").cast("string"))
