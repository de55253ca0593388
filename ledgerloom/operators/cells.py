"""Discovery over sheet cells: metrics, capabilities, regions, header and schema inference.

Cells are long rows (file, sheet, sheet_idx, row, col, value_str, value_num, formula).
Everything ordered inside a sheet goes through row bands, so one huge sheet is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import as_number, clean_text, norm_header, ratio, slug
from ledgerloom.functions.text import ERROR_TOKENS
from ledgerloom.operators import banding
from ledgerloom.session import written

C = F.col
SHEET = ["file", "sheet", "sheet_idx"]
BAND_ROWS = 1024

# Label patterns of the ten headline metrics.
METRIC_PATTERNS = {
    "contract_value": r"\bcontract(?:ed)?\s+(?:value|price)\b|\bcontract\s+amount\b",
    "budget": r"\btotal\s+budget(?:ed)?\s+cost\b|\bbudget\s+cost\b|\boriginal\s+budget\b",
    "earned_value": r"\btotal\s+earned\s+value\b|\bearned\s+value\b|\bev\b",
    "actual_cost": r"\btotal\s+actual\s+cost\b|\bactual\s+cost\b|\bac\b",
    "cost_variance": r"\bcost\s+variance\b|\bcv\b",
    "cpi": r"\bcpi\b|cost\s+performance\s+index",
    "revenue": r"\brevenue\b|cash\s*in",
    "gross_profit": r"\bgross\s+profit\b|\bnet\s+profit\b",
    "direct_cost": r"\bactual\s+direct\s+cost\b|\bdirect\s+actual\s+cost\b|\bdirect\s+cost\b",
    "indirect_cost": r"\bactual\s+indirect\s+cost\b|\bindirect\s+actual\s+cost\b|\bindirect\s+cost\b",
}
SUMMARY_SHEETS = ["dashboard", "gross profit", "project summary", "1. project summary"]
# Keywords of the fourteen capabilities.
CAPABILITIES = {
    "overview": ["dashboard", "summary"],
    "project_summary": ["project summary", "wbs"],
    "cashflow": ["cashflow", "cash flow", "cash-flow"],
    "direct_cost": ["direct", "resource"],
    "indirect_cost": ["indirect"],
    "boq": ["boq"],
    "forecast": ["forecast", "eac", "etc", "vac"],
    "ledger": ["expense", "ledger", "transaction"],
    "cost_codes": ["cost code"],
    "waste": ["waste", "wastage"],
    "wages": ["wage", "salary", "payroll"],
    "reallocation": ["reallocation", "realloc"],
    "assets": ["asset"],
    "balance": ["balance", "reconciliation"],
}


def number_of(c: str = "value") -> Column:
    return F.coalesce(C(f"{c}_num"), as_number(f"{c}_str"))


def band_of(row: str = "row") -> Column:
    return F.floor(C(row) / BAND_ROWS)


# ---------------------------------------------------------------- metrics


def metric_candidates(cells: DataFrame) -> DataFrame:
    """Label cells of the metric families with their nearest number: up to 6 right, else 3 down.

    Patterns run on distinct labels; a label cell probes nine positions with an equi-join.
    """
    rules = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(p).alias("pattern")) for m, p in METRIC_PATTERNS.items()])
    texts = cells.filter("value_str IS NOT NULL").select(*SHEET, "row", "col", clean_text("value_str").alias("label"))
    matched = (
        texts.select("label").distinct().select("label", F.lower("label").alias("low"), F.inline(rules))
        .filter(F.expr("regexp_like(low, pattern)")).select("label", "metric"))
    labels = texts.join(matched, "label")
    probes = F.array(
        *[F.struct(C("row").alias("prow"), (C("col") + d).alias("pcol"), F.lit(d).alias("distance")) for d in range(1, 7)],
        *[F.struct((C("row") + d).alias("prow"), C("col").alias("pcol"), F.lit(6 + d).alias("distance")) for d in range(1, 4)])
    numbers = cells.select(*[C(k) for k in SHEET], C("row").alias("prow"), C("col").alias("pcol"), number_of().alias("value")).filter(
        "value IS NOT NULL")
    hits = labels.select(*SHEET, "row", "col", "label", "metric", F.inline(probes)).join(numbers, [*SHEET, "prow", "pcol"])
    best = hits.groupBy(*SHEET, "row", "col", "label", "metric").agg(
        F.min_by("value", "distance").alias("value"), F.min("distance").alias("distance"))
    low = F.lower("label")
    bonus = (
        F.when(low.contains("total"), 20).otherwise(0) + F.when(low.contains("actual"), 25).otherwise(0)
        + F.when(F.regexp_replace(F.lower("sheet"), r"^[ .]+|[ .]+$", "").isin(SUMMARY_SHEETS), 15).otherwise(0))
    return best.withColumn("score", 100 - C("distance") + bonus)


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """All candidates with their rank per file and metric; rank 1 is preferred, ties keep cell order. Numbered score by score."""
    return banding.row_number(candidates, ["file", "metric"], -C("score"), ["sheet_idx", "row", "col"], "rank")


def derived_metrics(ranked: DataFrame) -> DataFrame:
    """CPI and CV from the preferred earned value and actual cost, when both exist and AC is not 0."""
    p = ranked.filter("rank = 1").groupBy("file").agg(
        F.max(F.when(C("metric") == "earned_value", C("value"))).alias("ev"),
        F.max(F.when(C("metric") == "actual_cost", C("value"))).alias("ac"))
    return p.filter("ev IS NOT NULL AND ac <> 0").select(
        "file", ratio("ev", "ac").alias("derived_cpi"), (C("ev") - C("ac")).alias("derived_cv"))


def capabilities(cells: DataFrame) -> DataFrame:
    """Fourteen flags per file: keyword families found in sheet names or in any cell text."""
    def found(text: Column) -> list[Column]:
        out = []
        for name, words in CAPABILITIES.items():
            hit = F.lit(False)
            for w in words:
                hit = hit | text.contains(w)
            out.append(F.coalesce(F.bool_or(hit), F.lit(False)).alias(name))
        return out

    texts = cells.select("file", F.lower("value_str").alias("t")).filter("t IS NOT NULL")
    names = cells.select("file", F.lower("sheet").alias("t")).distinct()
    return texts.unionByName(names).groupBy("file").agg(*found(C("t")))


def quality_findings(cells: DataFrame, ranked: DataFrame) -> DataFrame:
    """A warning per formula-error cell and an info finding per headline metric without a value."""
    errors = cells.filter(C("value_str").isin(ERROR_TOKENS)).select(
        "file", F.lit("warning").alias("severity"), F.lit("SOURCE_FORMULA_ERROR").alias("code"),
        F.concat_ws("!", "sheet", F.concat_ws(",", C("row").cast("string"), C("col").cast("string"))).alias("detail"))
    wanted = cells.select("file").distinct().select(
        "file", F.explode(F.array(F.lit("budget"), F.lit("earned_value"), F.lit("actual_cost"))).alias("metric"))
    missing = wanted.join(ranked.filter("rank = 1").select("file", "metric"), ["file", "metric"], "left_anti").select(
        "file", F.lit("info").alias("severity"), F.lit("STANDARD_METRIC_NOT_DETECTED").alias("code"), C("metric").alias("detail"))
    return errors.unionByName(missing)


# ----------------------------------------------------------------- regions


def table_regions(cells: DataFrame) -> DataFrame:
    """Table-like blocks: rows with two or more cells, a jump of more than two rows starts a block."""
    long_text = C("value_str").isNotNull() & (F.length(clean_text("value_str")) >= 2)
    rows = cells.groupBy(*SHEET, "row").agg(F.count("*").alias("n"), F.count_if(long_text).alias("n_text")).filter("n >= 2")
    # The numbered rows are read by every step below: they are written once instead of recounting the cells.
    marked = written(banding.islands(rows, SHEET, band_of(), "row", 2, "block", "prev"), "table-rows")
    key = [*SHEET, "block"]
    blocks = marked.groupBy(*key).agg(F.count("*").alias("n_rows"), F.max("row").alias("end_row"), F.max_by("prev", "row").alias("second_last")).filter("n_rows >= 3")
    heads = marked.join(blocks, key).filter((C("n_text") >= 2) & (C("row") < C("second_last"))).groupBy(*key).agg(
        F.min("row").alias("header_row"), F.first("end_row").alias("end_row"))
    body = marked.select(*key, "row").join(heads, key).filter("row >= header_row")
    in_body = cells.join(body.select(*SHEET, "row", "block", "header_row"), [*SHEET, "row"])
    text = F.coalesce(clean_text("value_str"), F.lit(""))
    text = F.when(C("value_str").isNull() & C("value_num").isNotNull(), C("value_num").cast("string")).otherwise(text)
    cols = in_body.groupBy(*key, "col").agg(F.max(F.when(C("row") == C("header_row"), text)).alias("header"))
    shaped = cols.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("col", F.coalesce("header", F.lit("")).alias("header")))).alias("c"))
    sizes = body.groupBy(*key).agg((F.count("*") - 1).alias("row_count"))
    out = heads.join(shaped, key).join(sizes, key).filter(F.size("c") >= 2)
    return out.select(
        *SHEET, F.concat(slug("sheet"), F.lit("-r"), C("header_row").cast("string")).alias("table_id"), "header_row", "end_row",
        C("c.col").alias("columns"), C("c.header").alias("headers"), "row_count")


def region_rows(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Cells of each region as one record per row; blank rows have no cells and drop out.

    Both sides meet on the row band, so a hot sheet is joined band by band.
    """
    spans = F.sequence(F.floor(C("header_row") / BAND_ROWS), F.floor(C("end_row") / BAND_ROWS))
    r = regions.select(*SHEET, "table_id", "header_row", "end_row", F.explode(spans).alias("band"))
    j = cells.withColumn("band", band_of()).join(r, [*SHEET, "band"]).filter((C("row") > C("header_row")) & (C("row") <= C("end_row")))
    value = F.coalesce("value_str", C("value_num").cast("string"))
    return j.groupBy(*SHEET, "table_id", "row").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(C("col"), value.alias("v"))))).alias("record"))


def preview(cells: DataFrame, max_rows: int = 30, max_cols: int = 16) -> DataFrame:
    """First populated rows x first populated columns of every sheet, as a dense matrix row."""
    filled = cells.filter("value_str IS NOT NULL OR value_num IS NOT NULL")

    def first(col: str, n: int) -> DataFrame:
        d = filled.select(*SHEET, col).distinct()
        return d.withColumn("rk", F.row_number().over(W.partitionBy(*SHEET).orderBy(col))).filter(C("rk") <= n)

    cols = first("col", max_cols).groupBy(*SHEET).agg(F.sort_array(F.collect_list("col")).alias("cols"))
    rows = first("row", max_rows).select(*SHEET, "row")
    value = F.coalesce("value_str", C("value_num").cast("string"))
    grid = filled.join(rows, [*SHEET, "row"]).groupBy(*SHEET, "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", value.alias("v")))).alias("m"))
    return grid.join(cols, SHEET).select(*SHEET, "row", F.transform("cols", lambda c: F.try_element_at("m", c)).alias("cells"))


def manifest(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Sheet manifest: cell, row, column and table counts."""
    t = regions.groupBy(*SHEET).agg(F.count("*").alias("table_count"))
    g = cells.groupBy(*SHEET).agg(
        F.count("*").alias("cell_count"), F.max("row").alias("max_row"), F.max("col").alias("max_col"),
        F.count_if(C("value_str").isNotNull()).alias("text_cells"))
    return g.join(t, SHEET, "left").withColumn("table_count", F.coalesce("table_count", F.lit(0)))


def chunks(cells: DataFrame, primary: int = 5000, size: int = 25000) -> DataFrame:
    """Position of every cell in its sheet, with the primary-window flag and its chunk."""
    n = banding.row_number(cells, SHEET, band_of(), ["row", "col"], "position")
    idx = F.floor((C("position") - 1) / size)
    return n.select(*SHEET, "row", "col", "position", (C("position") <= primary).alias("in_primary"),
                    (idx + 1).alias("chunk_index"), (idx * size).alias("start_cell_index"))


def sheet_profile(cells: DataFrame, sample_cells: int | None = 300, sample_chars: int = 10000) -> DataFrame:
    """Size, type counts, densities and a text sample of the first texts of each sheet."""
    numeric, formula = C("value_num").isNotNull(), C("formula").isNotNull()
    text = C("value_str").isNotNull() & (C("value_str") != "")
    g = cells.groupBy(*SHEET).agg(
        F.max("row").alias("row_count"), F.max("col").alias("col_count"), F.count("*").alias("nonempty_cells"),
        F.count_if(numeric).alias("numeric_cells"), F.count_if(formula).alias("formula_cells"), F.count_if(text).alias("text_cells"))
    w = W.partitionBy(*SHEET).orderBy("row", "col")
    first = cells.filter(text).withColumn("rk", F.row_number().over(w)).filter(C("rk") <= sample_cells)
    sample = first.groupBy(*SHEET).agg(F.substring(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("rk", "value_str"))), lambda x: x["value_str"]), " | "), 1, sample_chars).alias("text_sample"))
    return g.join(sample, SHEET, "left").select(
        "*", ratio("numeric_cells", "nonempty_cells").alias("numeric_density"), ratio("formula_cells", "nonempty_cells").alias("formula_density"))


def formula_signature(f: Column) -> Column:
    s = F.regexp_replace(F.upper(f), r"\$?[A-Z]{1,3}\$?\d+", "CELL")
    s = F.regexp_replace(s, r"\d+(?:\.\d+)?", "NUM")
    return F.regexp_replace(s, r"\s+", "")


def search(cells: DataFrame, text: str, page: int, size: int = 250) -> DataFrame:
    """Case-insensitive search over value, reference and formula; one ordered page."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("value_str", C("value_num").cast("string")), "ref", "formula"))
    order = ["file", "sheet_idx", "row", "col"]
    return cells.filter(hay.contains(text.lower())).orderBy(*order).offset((page - 1) * size).limit(size)


def row_numbers_right(cells: DataFrame, lexicon_hits: DataFrame) -> DataFrame:
    """Nearest number to the right in the same row at any distance, for matched labels.

    Instead of pairing a label with every number of its row, labels and numbers are laid
    out in column order and each label takes the next number: one window per sheet row.
    """
    texts = cells.filter("value_str IS NOT NULL").join(lexicon_hits, "value_str").select(
        *SHEET, "row", "col", "metric", "match_score", "value_str", F.lit(None).cast("double").alias("n"))
    numbers = cells.filter("value_num IS NOT NULL").select(
        *SHEET, "row", "col", F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("match_score"),
        F.lit(None).cast("string").alias("value_str"), C("value_num").alias("n"))
    after = W.partitionBy(*SHEET, "row").orderBy("col").rowsBetween(1, W.unboundedFollowing)
    near = texts.unionByName(numbers).select(
        "*", F.first(F.when(C("n").isNotNull(), F.struct(C("col").alias("value_col"), C("n").alias("value"))), ignorenulls=True).over(after).alias("v"))
    cand = near.filter("metric IS NOT NULL").select(*SHEET, "row", "col", "metric", "match_score", C("value_str").alias("label"), "v.value_col", "v.value")
    w = W.partitionBy("file", "metric").orderBy(C("value").isNull(), F.desc("match_score"), "sheet_idx", "row", "col")
    return cand.withColumn("rank", F.row_number().over(w))


# ------------------------------------------------------- schema inference


def header_scores(headers: DataFrame, schema: dict[str, list[str]], text: str = "header") -> DataFrame:
    """Best alias score of every (distinct header, field) pair above zero."""
    import re as _re

    def norm(a: str) -> str:
        return _re.sub(r"\s+", " ", _re.sub(r"[#%()\[\]{}:_/\\.-]+", " ", a.casefold())).strip()

    aliases = [(f, norm(a)) for f, al in schema.items() for a in al]
    table = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(a).alias("alias"), F.array(*[F.lit(t) for t in dict.fromkeys(a.split(" "))]).alias("at")) for f, a in aliases if a])
    d = headers.select(text).distinct().withColumn("h", norm_header(text)).filter("h <> ''").withColumn("ht", F.array_distinct(F.split("h", " ")))
    near = C("h").contains(C("alias")) | C("alias").contains(C("h"))
    pairs = d.select(text, "h", "ht", F.inline(table)).filter(near | F.arrays_overlap("at", "ht"))  # any other pair scores 0
    common = F.size(F.array_intersect("at", "ht"))
    overlap = common / (F.size("at") + F.size("ht") - common) * 7.0
    la, lh = F.length("alias"), F.length("h")
    contains = F.when(near, F.least(la, lh) / F.greatest(la, lh) + 7.5).otherwise(F.lit(0.0))
    score = (
        F.when(C("h") == C("alias"), 10.0)
        .when(la <= 3, F.when(F.array_contains("ht", C("alias")), 8.5).otherwise(0.0))
        .otherwise(F.greatest(contains, overlap)))
    return pairs.select(text, "field", score.alias("score")).groupBy(text, "field").agg(F.max("score").alias("score")).filter("score > 0")


def headers_by_schema(cells: DataFrame, schemas: Mapping[str, dict[str, list[str]]]) -> DataFrame:
    """Per sheet and schema the best header row, wherever it stands: greedy one-to-one field/column assignment, highest total first, then the earliest.

    All schemas share one pass. Distinct texts are scored first and written, so that the join of the cells knows how few of them score. Rows whose
    scoring cells are the same texts in the same columns get the same assignment: it is found once for the first of them.
    """
    fields = {f"{name}\n{f}": aliases for name, schema in schemas.items() for f, aliases in schema.items()}
    zone = cells.filter(C("value_str").isNotNull()).select(*SHEET, "row", "col", C("value_str").alias("header"))
    scores = header_scores(zone, fields).filter("score >= 5").select("header", F.split("field", "\n").alias("f"), "score")
    scores = written(scores.groupBy("header").agg(F.collect_list(F.struct("score", C("f")[1].alias("field"), C("f")[0].alias("schema"))).alias("s")), "header-scores")
    places = zone.join(scores.select("header"), "header").groupBy(*SHEET, "row").agg(F.sort_array(F.collect_list(F.struct("col", "header"))).alias("places"))
    kinds = places.groupBy(*SHEET, "places").agg(F.min("row").alias("row"))
    scored = kinds.select(*SHEET, "row", F.inline("places")).join(scores, "header").select(*SHEET, "row", "col", F.inline("s"))
    # One row of candidates is at most (columns x fields) long.
    cand = scored.groupBy(*SHEET, "schema", "row").agg(F.sort_array(F.collect_list(F.struct("score", "field", "col")), asc=False).alias("cand"))
    init = F.struct(F.array().cast("array<string>").alias("fields"), F.array().cast("array<long>").alias("cols"), F.lit(0.0).alias("total"))

    def take(acc, x):
        used = F.array_contains(acc["fields"], x["field"]) | F.array_contains(acc["cols"], x["col"].cast("long"))
        grown = F.struct(F.concat(acc["fields"], F.array(x["field"])).alias("fields"),
                         F.concat(acc["cols"], F.array(x["col"].cast("long"))).alias("cols"), (acc["total"] + x["score"]).alias("total"))
        return F.when(used, acc).otherwise(grown)

    folded = cand.select(*SHEET, "schema", "row", F.aggregate("cand", init, take).alias("a"))
    scored_rows = folded.select(*SHEET, "schema", "row", C("a.fields").alias("fields"), C("a.cols").alias("cols"),
                                F.round(C("a.total") + F.size("a.fields") * 2.0, 9).alias("score"))
    best = F.min_by(F.struct(C("row").alias("header_row"), "fields", "cols", "score"), F.struct((-C("score")).alias("s"), C("row")))
    # One row per sheet and schema, read by every later step: written, so that their joins broadcast it.
    return written(scored_rows.groupBy(*SHEET, "schema").agg(best.alias("b")).select(*SHEET, "schema", "b.*"), "header-rows")


def header_rows(cells: DataFrame, schema: dict[str, list[str]]) -> DataFrame:
    """``headers_by_schema`` for one schema."""
    return headers_by_schema(cells, {"": schema}).drop("schema")


def schema_sheet(cells: DataFrame, schema: dict[str, list[str]], required: Iterable[str], hints: Iterable[str],
                 min_fields: int, min_score: float, heads: DataFrame | None = None) -> DataFrame:
    """The sheet of each file that carries the schema, with its mapping and confidence; ``heads`` are header rows found before."""
    heads = heads if heads is not None else header_rows(cells, schema)
    need = F.array(*[F.lit(r) for r in required])
    ok = heads.filter(F.size(F.array_except(need, "fields")) == 0)
    name = norm_header("sheet")
    bonus = F.lit(0.0)
    for h in hints:
        bonus = bonus + F.when(name.contains(h), 8.0).otherwise(0.0)
    ranked = ok.withColumn("adjusted", C("score") + bonus)
    order = F.struct((-C("adjusted")).alias("a"), C("sheet_idx"))
    best = ranked.groupBy("file").agg(F.min_by(F.struct("sheet", "sheet_idx", "header_row", "fields", "cols", "adjusted"), order).alias("b")).select("file", "b.*")
    conf = F.least(F.lit(1.0), F.size("fields") / len(schema))
    return best.filter((F.size("fields") >= min_fields) & (C("adjusted") >= min_score)).withColumn("confidence", F.round(conf, 3))


def mapped_rows(cells: DataFrame, chosen: DataFrame, text_fields: list[str], number_fields: list[str]) -> DataFrame:
    """Rows below the header as typed records, one column per canonical field, with provenance."""
    m = chosen.select("file", "sheet", "header_row", "confidence", F.explode(F.arrays_zip("fields", "cols")).alias("z")).select(
        "file", "sheet", "header_row", "confidence", C("z.fields").alias("field"), C("z.cols").alias("col"))
    j = cells.withColumn("col", C("col").cast("long")).join(m, ["file", "sheet", "col"]).filter("row > header_row")
    text = F.coalesce("value_str", C("value_num").cast("string"))
    aggs = [F.max(F.when(C("field") == f, text)).alias(f) for f in text_fields]
    aggs += [F.max(F.when(C("field") == f, number_of())).alias(f) for f in number_fields]
    # header row and confidence belong to the sheet: grouped by row alone, the records are dealt as those they are joined with
    own = [F.first(c).alias(c) for c in ("header_row", "confidence")]
    return j.groupBy("file", "sheet", "row").agg(*own, *aggs)


def provenance() -> Column:
    """Evidence struct carried by derived records."""
    return F.struct(C("sheet").alias("source_sheet"), C("row").alias("source_row"), C("header_row").alias("source_header_row"),
                    C("confidence").alias("mapping_confidence"))


