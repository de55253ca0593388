"""Registered cell queries (D01-D22, S13, S15-S17) and cell-based extraction."""

from pyspark.sql import functions as F

from ledgerloom.functions import as_number, cell_state, codeish, excel_month, norm_header, slug
from ledgerloom.functions.text import column_letters, split_ref
from ledgerloom.operators import cells as op
from ledgerloom.operators import extract as ex
from ledgerloom.operators import normalize as nz
from ledgerloom.operators.schemas import DIRECT_SCHEMA, WASTE_ROWS
from ledgerloom.plans import bindings as b
from ledgerloom.plans import workbook as wb
from ledgerloom.plans.bindings import RUN, S, sql_with
from ledgerloom.plans.registry import query
from ledgerloom.session import cut

C = F.col
P_COLS = [("p_partkey", True), ("p_name", False), ("p_brand", False), ("p_type", False), ("p_size", True), ("p_retailprice", True)]
S_COLS = [("s_suppkey", True), ("s_name", False), ("s_acctbal", True)]


def _book_sql(t, idx, key, cols):
    vals = ",".join(f"({i},{'NULL' if n else c},{c + '::DOUBLE' if n else 'NULL'})" for i, (c, n) in enumerate(cols, 1))
    heads = ",".join(f"({i},'{c}',NULL::DOUBLE)" for i, (c, _) in enumerate(cols, 1))
    return (f"SELECT 'book' AS file, '{t}' AS sheet, {idx} AS sheet_idx, {key}+2 AS row, v.* FROM {t}, LATERAL (VALUES {vals}) v(col,value_str,value_num)"
            f" UNION ALL SELECT 'book', '{t}', {idx}, 1, h.* FROM (VALUES {heads}) h(col,value_str,value_num)")


b.define("cells", _book_sql("part", 1, "p_partkey", P_COLS) + " UNION ALL " + _book_sql("supplier", 2, "s_suppkey", S_COLS))


def dashboards(spark, sf):
    return cut(wb.dashboard_sheet(spark, sf))


@query("d01_cell_references", sql_with("""
SELECT row, n, CASE WHEN n<=26 THEN chr(64+n) WHEN n<=702 THEN chr(64+(n-1)//26)||chr(65+(n-1)%26) ELSE chr(64+((n-1)//26-1)//26)||chr(65+((n-1)//26-1)%26)||chr(65+(n-1)%26) END||row AS ref, row AS back_row, n AS back_col
FROM (SELECT CAST(p_partkey+1 AS BIGINT) AS row, CAST(p_partkey*7%16384+1 AS INT) AS n FROM part)"""))
def d01(spark, sf):
    p = b.table(spark, sf, "part").select((C("p_partkey") + 1).alias("row"), (C("p_partkey") * 7 % 16384 + 1).cast("int").alias("n"))
    d = p.withColumn("ref", F.concat(column_letters(C("n")), C("row").cast("string")))
    r, c = split_ref(F.lower("ref"))
    return d.select("row", "n", "ref", r.cast("long").alias("back_row"), c.cast("int").alias("back_col"))


@query("d02_text_normal_forms", r"""
SELECT doc_id, CASE WHEN s='' THEN 'project' ELSE s END AS slug, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(h,'\s+',' ','g'))),'[#%()\[\]{}:_/\\.-]+',' ','g'),'\s+',' ','g')) AS header
FROM (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(strip_accents(text),'[^\x00-\x7F]','','g'),'[^A-Za-z0-9]+','-','g'),'^-+|-+$','','g')) AS s, source||' [% '||lang||'/x] : '||n_chars AS h FROM documents)""")
def d02(spark, sf):
    h = F.concat(C("source"), F.lit(" [% "), C("lang"), F.lit("/x] : "), C("n_chars").cast("string"))
    return b.table(spark, sf, "documents").select("doc_id", slug("text", unicode_fold=True).alias("slug"), norm_header(h).alias("header"))


NUMBER_TEXTS = ["'$'||p_size||',500.5'", "p_size||'%'", "' -'||p_size||' '", "p_size||'e3'", "'EGP'||p_size", "p_name", "'+'||p_size||'.25'", "p_size||'.'"]


@query("d03_numeric_coercion", "SELECT p_partkey, kind, CASE kind WHEN 0 THEN (p_size||'500.5')::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN -p_size::DOUBLE WHEN 4 THEN p_size::DOUBLE WHEN 6 THEN p_size+0.25::DOUBLE END AS number FROM part, (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) v(kind)")
def d03(spark, sf):
    items = [F.struct(F.lit(i).alias("kind"), F.expr(t).alias("t")) for i, t in enumerate(NUMBER_TEXTS)]
    return b.table(spark, sf, "part").select("p_partkey", F.inline(F.array(*items))).select("p_partkey", "kind", as_number("t").alias("number"))


b.define("candidates", """
SELECT name AS file, 'Dashboard' AS sheet, 'budget' AS metric, 'Total Budget Cost' AS label, m_budget AS value, 134 AS score, 1 AS sheet_idx, 2 AS row FROM model
UNION ALL SELECT name, 'Dashboard', 'earned_value', 'Total Earned Value', m_earned_value, 133, 1, 3 FROM model
UNION ALL SELECT name, 'Notes', 'earned_value', 'earned value', 1.0, 99, 9, 1 FROM model
UNION ALL SELECT name, 'Dashboard', 'actual_cost', 'Total Actual Cost', m_actual_cost, 153, 1, 4 FROM model
UNION ALL SELECT name, 'Dashboard', 'direct_cost', 'Actual Direct Cost', floor(m_direct_cost), 139, 1, 7 FROM model
UNION ALL SELECT name, 'Dashboard', 'revenue', 'Revenue', m_revenue, 114, 1, 12 FROM model WHERE m_revenue IS NOT NULL
UNION ALL SELECT name, 'Dashboard', 'revenue', 'Revenue per m2', 5.0, 112, 1, 13 FROM model
UNION ALL SELECT name, 'Dashboard', 'gross_profit', 'Net Profit', m_gross_profit, 114, 1, 14 FROM model WHERE m_gross_profit IS NOT NULL""", "model")


@query("d04_metric_candidates", sql_with("SELECT file, sheet, metric, label, value, score FROM candidates", "candidates"))
def d04(spark, sf):
    cells = dashboards(spark, sf).unionByName(wb.book_cells(spark, sf))
    return op.metric_candidates(cells).select("file", "sheet", "metric", "label", "value", "score")


def ranked(spark, sf):
    return op.rank_candidates(op.metric_candidates(dashboards(spark, sf)))


@query("d05_candidate_ranking", sql_with("""
SELECT file, metric, label, value, row_number() OVER (PARTITION BY file, metric ORDER BY score DESC, sheet_idx, row) AS rank FROM candidates""", "candidates"))
def d05(spark, sf):
    return ranked(spark, sf).select("file", "metric", "label", "value", C("rank").cast("long").alias("rank"))


@query("d06_derived_metrics", sql_with("SELECT name AS file, m_earned_value/m_actual_cost AS derived_cpi, m_earned_value-m_actual_cost AS derived_cv FROM model", "model"))
def d06(spark, sf):
    return op.derived_metrics(ranked(spark, sf))


def capability_cells(spark, sf):
    """A text sheet per source of documents: every line of every document is a cell."""
    d = b.table(spark, sf, "documents").select(C("source").alias("file"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value_str"))
    return d.select("file", F.lit("Project Summary").alias("sheet"), F.lit(1).alias("sheet_idx"), C("doc_id").alias("row"), (C("pos") + 1).cast("long").alias("col"),
                    "value_str", F.lit(None).cast("double").alias("value_num"), F.lit(None).cast("string").alias("formula"))


@query("d07_capability_flags", "SELECT source AS file, " + ", ".join(
    "bool_or(" + " OR ".join(f"contains(lower(text),'{w}')" for w in words) + ")"
    + (" OR true" if any(w in "project summary" for w in words) else "") + f" AS {n}" for n, words in op.CAPABILITIES.items())
    + " FROM documents GROUP BY source")
def d07(spark, sf):
    return op.capabilities(capability_cells(spark, sf))


REGION_SQL = """SELECT file, sheet, sheet_idx, sheet||'-r1' AS table_id, 1 AS header_row, max(row) AS end_row, count(DISTINCT col) AS n_columns,
 string_agg(DISTINCT CASE WHEN row=1 THEN value_str END, ',') AS hdr, count(DISTINCT row)-1 AS row_count FROM cells GROUP BY 1,2,3"""
b.define("regions", REGION_SQL, "cells")


@query("d08_table_regions", sql_with("""
SELECT sheet, table_id, header_row, end_row, n_columns, row_count FROM regions UNION ALL
SELECT n_name, 'NATION', 1, 1, 0, 0 FROM nation WHERE false""", "regions"))
def d08(spark, sf):
    r = op.table_regions(wb.book_cells(spark, sf))
    return r.select("sheet", "table_id", "header_row", "end_row", F.size("columns").cast("long").alias("n_columns"), "row_count")


@query("d09_region_rows", sql_with("""
SELECT sheet, row, string_agg(col||'='||CASE WHEN value_str IS NOT NULL THEN value_str ELSE CAST(value_num AS VARCHAR) END, ';' ORDER BY col) AS record FROM cells WHERE row>1 GROUP BY 1,2""", "cells"))
def d09(spark, sf):
    cells = wb.book_cells(spark, sf)
    rows = op.region_rows(cells, op.table_regions(cells))
    pairs = F.transform(F.map_entries("record"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return rows.select("sheet", "row", F.array_join(pairs, ";").alias("record"))


_ALIASES = [(f, a) for f, al in DIRECT_SCHEMA.items() for a in al]


def _alias_sql():
    import re
    out = []
    for f, a in _ALIASES:
        n = re.sub(r"\s+", " ", re.sub(r"[#%()\[\]{}:_/\\.-]+", " ", a)).strip()
        out.append(f"('{f}','{n}')")
    return ",".join(out)


@query("d10_header_alias_score", rf"""
SELECT header, field, round(max(score),6) AS score FROM (SELECT header, field, CASE WHEN h=alias THEN 10.0::DOUBLE WHEN len(alias)<=3 THEN CASE WHEN list_contains(string_split(h,' '),alias) THEN 8.5::DOUBLE ELSE 0 END
 ELSE greatest(CASE WHEN contains(h,alias) OR contains(alias,h) THEN 7.5::DOUBLE+least(len(alias),len(h))::DOUBLE/greatest(len(alias),len(h)) ELSE 0 END,
  len(list_intersect(string_split(h,' '),string_split(alias,' ')))::DOUBLE/len(list_distinct(list_concat(string_split(h,' '),string_split(alias,' '))))*7) END AS score
 FROM (SELECT DISTINCT header, lower(trim(regexp_replace(regexp_replace(header,'[#%().]+',' ','g'),'\s+',' ','g'))) AS h FROM (SELECT p_name||' Cost' AS header FROM part UNION ALL SELECT 'Budget ('||p_type||')' FROM part UNION ALL SELECT 'Actual '||p_brand FROM part)),
 (VALUES {_alias_sql()}) a(field,alias)) WHERE score>0 GROUP BY 1,2""")
def d10(spark, sf):
    p = b.table(spark, sf, "part")
    heads = p.select(F.explode(F.array(
        F.concat(C("p_name"), F.lit(" Cost")), F.concat(F.lit("Budget ("), C("p_type"), F.lit(")")), F.concat(F.lit("Actual "), C("p_brand")))).alias("header"))
    return op.header_scores(heads, DIRECT_SCHEMA).withColumn("score", F.round("score", 6))


@query("d11_header_row_inference", sql_with("""
SELECT n_name AS file, sheet, header_row, n_fields, score FROM nation, (VALUES ('Direct Details',3,12,142.5::DOUBLE),('Indirect Details',2,7,84.0::DOUBLE)) v(sheet,header_row,n_fields,score)
WHERE n_name IN (SELECT project FROM cost_lines)""", "cost_lines"))
def d11(spark, sf):
    cells = wb.workbook_cells(spark, sf, "direct", "indirect")
    h = op.header_rows(cells, DIRECT_SCHEMA)
    # One column per field and one field per column is an invariant of the assignment.
    ok = (F.size(F.array_distinct("cols")) == F.size("cols")) & (F.size(F.array_distinct("fields")) == F.size("fields"))
    return h.filter(ok).select("file", "sheet", C("header_row").cast("int").alias("header_row"), F.size("fields").alias("n_fields"), "score")


@query("d12_schema_sheet_selection", sql_with("""
SELECT n_name AS file, role, sheet, score, confidence FROM nation, (VALUES ('direct_details','Direct Details',150.5::DOUBLE,0.375::DOUBLE),('indirect_details','Indirect Details',104.0::DOUBLE,0.5::DOUBLE)) v(role,sheet,score,confidence)
WHERE n_name IN (SELECT project FROM cost_lines)""", "cost_lines"))
def d12(spark, sf):
    cells = wb.workbook_cells(spark, sf, "direct", "indirect")
    parts = [ex.role_sheet(cells, r).select("file", F.lit(r).alias("role"), "sheet", C("adjusted").alias("score"), "confidence") for r in ("direct_details", "indirect_details")]
    return parts[0].unionByName(parts[1])


CODE_TEXTS = ["regexp_replace(p_brand,'^Brand#','B.')", "p_brand", "'#'||p_size", "p_size||'.'||p_partkey", "p_name", "'A-'||p_size||'/x'", "repeat('a',70)||'.'||p_partkey||p_partkey||p_partkey", "' W'||p_size||' '"]


@query("d13_work_code_predicate", """
SELECT p_partkey, kind, CASE WHEN kind IN (0,3,5,7) THEN true WHEN kind=6 THEN 71+3*len(CAST(p_partkey AS VARCHAR))<=80 ELSE false END AS is_code FROM part, (VALUES (0),(1),(2),(3),(4),(5),(6),(7)) v(kind)""")
def d13(spark, sf):
    items = [F.struct(F.lit(i).alias("kind"), F.expr(t).alias("t")) for i, t in enumerate(CODE_TEXTS)]
    return b.table(spark, sf, "part").select("p_partkey", F.inline(F.array(*items))).select("p_partkey", "kind", codeish("t").alias("is_code"))


@query("d14_month_parsing", """
SELECT o_orderkey, kind, CASE WHEN kind IN (0,1,2,3,4,5,8) THEN strftime(d,'%Y-%m') WHEN kind=6 THEN CASE WHEN day(d)<=12 THEN printf('%04d-%02d',year(d),day(d)) ELSE strftime(d,'%Y-%m') END
 WHEN kind=9 THEN CASE WHEN year(d)>=2000 THEN strftime(d,'%Y-%m') END END AS month FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey%11 AS INT) AS kind FROM orders)""")
def d14(spark, sf):
    o = b.table(spark, sf, "orders").select("o_orderkey", C("o_orderdate").cast("date").alias("d"), (C("o_orderkey") % 11).cast("int").alias("kind"))
    text = F.lit(None).cast("string")
    for i, layout in ((0, "yyyy-MM-dd"), (1, "yyyy/MM/dd"), (2, "dd/MM/yyyy"), (3, "MMM-yy"), (4, "MMM yyyy"), (5, "yyyy-MM"), (6, "MM/dd/yyyy")):
        text = F.when(C("kind") == i, F.date_format("d", layout)).otherwise(text)
    text = F.when(C("kind") == 9, F.concat(F.lit("cost at "), F.date_format("d", "yyyy.MM"), F.lit(" end"))).when(C("kind") == 10, F.lit("n/a")).otherwise(text)
    number = F.when(C("kind") == 8, F.datediff("d", F.lit("1899-12-30").cast("date")).cast("double"))
    return o.select("o_orderkey", "kind", excel_month(text, number).alias("month"))


@query("d15_cell_state", """
SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN 'formula_error' WHEN 1 THEN 'missing' WHEN 2 THEN 'missing' WHEN 3 THEN 'formula_error' ELSE 'value' END AS state FROM part""")
def d15(spark, sf):
    v = F.expr("CASE p_partkey % 5 WHEN 0 THEN ' #ref! ' WHEN 1 THEN '' WHEN 3 THEN '#N/A' WHEN 4 THEN p_name END")
    return b.table(spark, sf, "part").select("p_partkey", cell_state(v).alias("state"))


@query("d16_quality_findings", sql_with("""
SELECT name AS file, 'warning' AS severity, 'SOURCE_FORMULA_ERROR' AS code, 'Dashboard!14,9' AS detail FROM model
UNION ALL SELECT project, 'warning', 'SOURCE_FORMULA_ERROR', 'Cash Flow!6,'||((CAST(substr(month,1,4) AS INT)-1995)*12+7) FROM cash WHERE month LIKE '%-06'
UNION ALL SELECT 'register', 'info', 'STANDARD_METRIC_NOT_DETECTED', m FROM (VALUES ('budget'),('earned_value'),('actual_cost')) v(m)""", "model", "cash"))
def d16(spark, sf):
    cells = dashboards(spark, sf).unionByName(wb.workbook_cells(spark, sf, "cash")).unionByName(wb.code_register(spark, sf))
    return op.quality_findings(cells, ranked(spark, sf))


@query("d17_row_provenance", sql_with("""
SELECT project AS file, main_code, division, 'Direct Details' AS source_sheet, CAST(substr(main_code,3) AS BIGINT)*1000+ascii(division)+ascii(substr(division,2,1)) AS source_row, 3 AS source_header_row, 0.375::DOUBLE AS mapping_confidence FROM direct_details""", "direct_details"))
def d17(spark, sf):
    return ex.direct_details(wb.workbook_cells(spark, sf, "direct")).select("file", "main_code", "division", "evidence.*").withColumn(
        "source_header_row", C("source_header_row").cast("int"))


@query("d18_formula_signature", r"""
SELECT signature, count(*) AS n FROM (SELECT CASE p_partkey%4 WHEN 0 THEN '=SUM(CELL:CELL)*NUM' WHEN 1 THEN '=CELL-CELL' WHEN 2 THEN '=IF(CELL>NUM,CELL,"'||upper(p_type)||'")' ELSE '='||repeat('CELL+',36) END AS signature FROM part
) GROUP BY signature""")
def d18(spark, sf):
    k = C("p_partkey").cast("string")
    f = (F.when(C("p_partkey") % 4 == 0, F.concat(F.lit("=sum($A$"), k, F.lit(":B"), k, F.lit(") * "), C("p_retailprice").cast("string")))
         .when(C("p_partkey") % 4 == 1, F.concat(F.lit("= AB"), k, F.lit(" - c"), k))
         .when(C("p_partkey") % 4 == 2, F.concat(F.lit("=IF(A1>"), C("p_size").cast("string"), F.lit(",B2,\""), C("p_type"), F.lit("\")")))
         .otherwise(F.concat(F.lit("="), F.repeat(F.concat(F.lit("Z"), k, F.lit(" + ")), 36))))
    return b.table(spark, sf, "part").select(op.formula_signature(f).alias("signature")).groupBy("signature").agg(F.count("*").alias("n"))


@query("d19_sheet_profile", sql_with("""
SELECT g.*, numeric_cells/nonempty_cells AS numeric_density, 0.0::DOUBLE AS formula_density, text_sample FROM (SELECT sheet, max(row) AS row_count, max(col) AS col_count, count(*) AS nonempty_cells,
 count(value_num) AS numeric_cells, CAST(0 AS BIGINT) AS formula_cells, count(*) FILTER (value_str<>'') AS text_cells FROM cells GROUP BY sheet) g
JOIN (SELECT sheet, substr(string_agg(value_str,' | ' ORDER BY row, col),1,10000) AS text_sample FROM (SELECT * FROM cells WHERE value_str<>'' QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY row, col)<=300) GROUP BY sheet) s ON s.sheet=g.sheet""".replace("g.*,", "g.sheet, row_count, col_count, nonempty_cells, numeric_cells, formula_cells, text_cells,"), "cells"))
def d19(spark, sf):
    return op.sheet_profile(wb.book_cells(spark, sf)).drop("file", "sheet_idx").withColumn("col_count", C("col_count").cast("int"))


@query("d20_row_metric_discovery", sql_with("""
SELECT name AS file, metric, label, value_col, value, rank FROM model, LATERAL (VALUES ('total_budget','Total Budget Cost',2,m_budget,1),('earned_value','Total Earned  Value',3,m_earned_value,2),('earned_value','earned value',2,1.0,1),
 ('actual_cost','Total Actual Cost',NULL,NULL,1),('actual_cost','Actual Direct Cost',NULL,NULL,2),('gross_profit','Net Profit',CASE WHEN m_gross_profit IS NOT NULL THEN 2 END,m_gross_profit,1),('revenue','Revenue',CASE WHEN m_revenue IS NOT NULL THEN 2 END,m_revenue,CASE WHEN m_revenue IS NULL THEN 2 ELSE 1 END),
 ('revenue','Revenue per m2',4,5.0,CASE WHEN m_revenue IS NULL THEN 1 ELSE 2 END),('cpi','CPI',NULL,NULL,1)) v(metric,label,value_col,value,rank)""", "model"))
def d20(spark, sf):
    cells = dashboards(spark, sf)
    from ledgerloom.operators.text import lexicon_match
    hits = lexicon_match(cells.filter("value_str IS NOT NULL").select(C("value_str").alias("label")).distinct(), fuzzy=False).select(
        C("label").alias("value_str"), "metric", C("score").alias("match_score"))
    out = op.row_numbers_right(cells, hits)
    return out.select("file", "metric", "label", C("value_col").cast("int").alias("value_col"), "value", C("rank").cast("int").alias("rank"))


@query("d21_cell_search", sql_with("""
SELECT sheet, row, col, value_str FROM cells WHERE contains(lower(coalesce(value_str,CAST(value_num AS VARCHAR))),'blue') ORDER BY sheet_idx, row, col LIMIT 250 OFFSET 250""", "cells"))
def d21(spark, sf):
    cells = wb.book_cells(spark, sf).withColumn("ref", F.concat(column_letters(C("col")), C("row").cast("string")))
    return op.search(cells, "BLUE", page=2).select("sheet", "row", "col", "value_str")


@query("d22_snapshot_grid", sql_with("""
SELECT sheet, row, string_agg(CASE WHEN value_str IS NOT NULL THEN value_str ELSE CAST(value_num AS VARCHAR) END,'|' ORDER BY col) AS line, (SELECT count(DISTINCT col) FROM cells x WHERE x.sheet=c.sheet) AS width FROM cells c GROUP BY sheet, row""", "cells"))
def d22(spark, sf):
    cells = wb.book_cells(spark, sf)
    value = F.coalesce("value_str", C("value_num").cast("string"))
    maps = cells.groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct(column_letters(C("col")).alias("k"), value.alias("v")))).alias("m"))
    used = maps.select("sheet", F.explode(F.map_keys("m")).alias("k")).distinct()
    order = used.groupBy("sheet").agg(F.sort_array(F.collect_list(F.struct(split_ref(F.concat(C("k"), F.lit("1")))[1].alias("n"), "k"))).alias("o"))
    j = maps.join(order, "sheet")
    return j.select("sheet", "row", F.array_join(F.transform("o", lambda x: F.try_element_at("m", x["k"])), "|").alias("line"),
                    F.size("o").cast("long").alias("width"))


@query("s13_cell_chunks", sql_with("""
SELECT sheet, row, col, position, position<=5000 AS in_primary, (position-1)//25000+1 AS chunk_index, (position-1)//25000*25000 AS start_cell_index FROM
(SELECT sheet, row, col, row_number() OVER (PARTITION BY sheet ORDER BY row, col) AS position FROM cells)""", "cells"))
def s13(spark, sf):
    return op.chunks(wb.book_cells(spark, sf)).drop("file", "sheet_idx")


@query("s15_sheet_preview", sql_with("""
SELECT c.sheet, c.row, string_agg(CASE WHEN value_str IS NOT NULL THEN value_str ELSE CAST(value_num AS VARCHAR) END,'|' ORDER BY col) AS line FROM cells c
JOIN (SELECT sheet, row FROM (SELECT DISTINCT sheet, row FROM cells) QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY row)<=30) x ON x.sheet=c.sheet AND x.row=c.row GROUP BY 1,2""", "cells"))
def s15(spark, sf):
    return op.preview(wb.book_cells(spark, sf)).select("sheet", "row", F.array_join("cells", "|").alias("line"))


@query("s16_sheet_manifest", sql_with("""
SELECT sheet, sheet_idx, count(*) AS cell_count, max(row) AS max_row, max(col) AS max_col, count(value_str) AS text_cells, CAST(1 AS BIGINT) AS table_count FROM cells GROUP BY 1,2""", "cells"))
def s16(spark, sf):
    cells = wb.book_cells(spark, sf)
    return op.manifest(cells, op.table_regions(cells)).drop("file").withColumn("max_col", C("max_col").cast("int"))


@query("s17_source_counts", sql_with("""
SELECT 'sheets' AS dataset, CAST(2 AS BIGINT) AS rows UNION ALL SELECT 'cells', count(*) FROM cells UNION ALL SELECT 'project_items', count(*) FROM direct_details
UNION ALL SELECT 'indirect_details', count(*) FROM indirect_details UNION ALL SELECT 'boq_resources', count(*) FROM boq_resources UNION ALL SELECT 'cashflow', count(*) FROM cash
UNION ALL SELECT 'expenses', count(*) FROM ledger""", "cells", "direct_details", "indirect_details", "boq_resources", "cash", "ledger"))
def s17(spark, sf):
    cells = wb.book_cells(spark, sf)
    sets = {"sheets": cells.select("file", "sheet").distinct(), "cells": cells, "project_items": nz.project_items(b.direct_details(spark, sf)),
            "indirect_details": b.indirect_details(spark, sf), "boq_resources": b.boq_resources(spark, sf), "cashflow": b.cash(spark, sf), "expenses": b.ledger(spark, sf)}
    return wb.union([d.agg(F.count("*").alias("rows")).select(F.lit(n).alias("dataset"), "rows") for n, d in sets.items()])


# ------------------------------------------------------ extraction from cells


@query("n01_direct_details", sql_with("""
SELECT project AS file, main_code, description, division, original_budget, bac, ev, ac, etc, eac, work_qty, final_qs_qty, invoice_pct, CAST(NULL AS DOUBLE) AS cv FROM direct_details""", "direct_details"))
def n01(spark, sf):
    cols = ["file", "main_code", "description", "division", "original_budget", "bac", "ev", "ac", "etc", "eac", "work_qty", "final_qs_qty", "invoice_pct", "cv"]
    return ex.direct_details(wb.workbook_cells(spark, sf, "direct", "indirect")).select(*cols)


@query("n03_indirect_details", sql_with("SELECT project AS file, main_code, description, original_budget, ev, ac, cv, bac, CAST(NULL AS DOUBLE) AS eac FROM indirect_details", "indirect_details"))
def n03(spark, sf):
    return ex.indirect_details(wb.workbook_cells(spark, sf, "direct", "indirect")).select(
        "file", "main_code", "description", "original_budget", "ev", "ac", "cv", "bac", "eac")


@query("n04_cashflow", sql_with(f"""
SELECT project AS file, month, cash_in, co AS cash_out, {RUN('coalesce(cash_in,0)')} AS cash_in_cum, {RUN('coalesce(co,0)')} AS cash_out_cum,
 CASE WHEN cash_in IS NULL THEN 'missing' ELSE 'value' END AS cash_in_state, CASE WHEN month LIKE '%-06' THEN 'formula_error' WHEN co IS NULL THEN 'missing' ELSE 'value' END AS cash_out_state
FROM (SELECT project, month, cash_in, CASE WHEN month NOT LIKE '%-06' THEN cash_out END AS co FROM cash)""", "cash"))
def n04(spark, sf):
    return ex.cashflow(wb.workbook_cells(spark, sf, "cash"))


@query("n05_cost_codes", """
SELECT code, description, account_type, row FROM (SELECT 'B.'||regexp_extract(p_brand,'(\\d+)$',1)||'.'||(p_partkey%500) AS code, p_name AS description, p_type AS account_type, p_partkey//2+2 AS row, p_partkey%2 AS band FROM part)
QUALIFY row_number() OVER (PARTITION BY code ORDER BY band, row)=1""")
def n05(spark, sf):
    return ex.cost_codes(wb.code_register(spark, sf)).drop("file")


@query("n06_ledger_extraction", sql_with("""
SELECT project AS file, main_code, resource AS resource_code, source, di AS raw_di, total_cost, total_qty, n_months, source AS item,
 row_number() OVER (PARTITION BY project ORDER BY CAST(substr(main_code,3) AS INT), resource, source, di) AS sn FROM ledger""", "ledger"))
def n06(spark, sf):
    return ex.ledger(wb.workbook_cells(spark, sf, "ledger")).select(
        "file", "main_code", "resource_code", "source", "raw_di", "total_cost", "total_qty", "n_months", "item", "sn")


@query("n09_indirect_pools", sql_with(f"""
SELECT project AS file, division AS category, {S('ac')} AS cost, 'granular' AS classification FROM cost_lines WHERE raw_di='I' GROUP BY 1,2
UNION ALL SELECT project, source, {S('ac')}, 'official' FROM cost_lines WHERE raw_di='I' GROUP BY 1,2""", "cost_lines"))
def n09(spark, sf):
    return ex.indirect_pools(wb.workbook_cells(spark, sf, "pools"))


@query("n10_direct_allocation", sql_with("SELECT project AS file, main_code, 'Works of '||main_code AS item, resource, actual_cost FROM boq_resources", "boq_resources"))
def n10(spark, sf):
    return ex.direct_allocation(wb.workbook_cells(spark, sf, "breakdown")).drop("row")


_WASTE_COLS = f"""SELECT n_name AS project, CASE p_type WHEN 'STANDARD' THEN 'steel' ELSE 'concrete' END AS m, l_discount>0.05::DOUBLE AS d, {S('l_quantity')} AS actual, {S('l_quantity*(1-l_discount)')} AS eng
 FROM lineitem JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY ALL"""
b.define("waste_cols", _WASTE_COLS)
_WASTE_KINDS = [("actual", WASTE_ROWS["actual"], "actual", False), ("engineering", WASTE_ROWS["engineering"], "eng", False), ("waste_pct", "% Actual Waste", "(actual-eng)/eng", True),
                ("budget_waste_pct", "% Budget Waste", "0.04::DOUBLE", True), ("waste_qty", "Actual Waste Quantity", "actual-eng", False)]


def _waste_sql(kind, label, expr, pct):
    def band(m):
        total = S(f"CASE WHEN m='{m}' THEN {expr} END")
        return f"round({total}" + (f"/count(*) FILTER (m='{m}')" if pct else "") + ",6)"

    return f"SELECT project AS file, '{kind}' AS kind, '{label}' AS label, {band('steel')} AS steel, {band('concrete')} AS concrete FROM waste_cols GROUP BY project"


@query("n12_waste_summary", sql_with(" UNION ALL ".join(_waste_sql(*k) for k in _WASTE_KINDS), "waste_cols"))
def n12(spark, sf):
    w = ex.waste_summary(wb.workbook_cells(spark, sf, "waste"))
    return w.withColumns({"steel": F.round("steel", 6), "concrete": F.round("concrete", 6)})


@query("n16_project_totals", sql_with(f"""
SELECT project AS file, 1000000+ascii(division)+ascii(substr(division,2,1)) AS row, 'total '||lower(division) AS text, CAST(1 AS BIGINT) AS numbers, {S('original_budget')} AS total FROM direct_details GROUP BY project, division""", "direct_details"))
def n16(spark, sf):
    return ex.project_totals(wb.workbook_cells(spark, sf, "direct")).withColumn("row", C("row").cast("int"))


@query("n21_learning_findings", sql_with("""
SELECT n_name AS file, role, confidence, CASE WHEN confidence>=0.65 THEN 'info' ELSE 'warning' END AS severity, detail FROM nation,
 (VALUES ('direct_details',0.375::DOUBLE,'direct_details: Direct Details'),('indirect_details',0.5::DOUBLE,'indirect_details: Indirect Details'),('ledger',0.533::DOUBLE,'ledger: Expense Ledger')) v(role,confidence,detail)
WHERE n_name IN (SELECT project FROM cost_lines)""", "cost_lines"))
def n21(spark, sf):
    return nz.learning_findings(ex.learning(wb.workbook_cells(spark, sf, "direct", "indirect", "ledger")))
