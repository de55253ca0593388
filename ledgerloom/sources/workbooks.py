"""Workbook ingest: zip-packaged sheet XML to cells and charts, one file per task row.

Decoding bytes is the only Python here; number formats, dates and everything after are
column expressions over the emitted rows.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import split_ref

C = F.col
# XML namespaces, builtin date formats and accepted extensions.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
CHART = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
BUILTIN_FORMATS = {
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM",
    20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0",
}
EXTENSIONS = [".xlsx", ".xlsm", ".otf", ".xsf", ".xdf", ".xml", ".html", ".htm"]
CHART_KINDS = ["bar", "line", "pie", "scatter", "area", "doughnut"]

CELL_SCHEMA = ("path string, error string, sheet string, sheet_idx int, state string, ref string, value_str string, value_num double, "
               "value_bool boolean, formula string, format_id int, format_code string")
CHART_SCHEMA = ("path string, error string, sheet string, title string, chart_type string, "
                "series array<struct<title:string,refs:array<string>,cached:array<string>>>")


def discover(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Source files under the folders with their bytes; temporary files and repeats are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return source_files(files)


def source_files(files: DataFrame) -> DataFrame:
    """Keep supported extensions, drop '~$' temporaries, one row per case-folded path."""
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    keep = files.filter(ext.isin(EXTENSIONS) & ~name.startswith("~$"))
    cols = [c for c in files.columns if c != "path"]
    first = keep.groupBy(F.lower("path").alias("_k")).agg(F.min_by(F.struct("path", *cols), "path").alias("r"))
    return first.select("r.*")


def is_date_format(format_id: Column, code: Column) -> Column:
    """Builtin date ids, or a custom code with d/m/y/h/s outside quotes, escapes and brackets."""
    bare = F.lower(F.regexp_replace(F.coalesce(code, F.lit("")), r'"[^"]*"|\\.|\[[^\]]*\]', ""))
    return format_id.isin(list(BUILTIN_FORMATS)) | bare.rlike("(^|[^a-z])[dmyhs]+([^a-z]|$)")


def _xml(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, base = posixpath.split(part)
    root = _xml(z, f"{folder}/_rels/{base}.rels")
    if root is None:
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") if not r.get("Target").startswith("/")
            else r.get("Target").lstrip("/") for r in root}


def _sheets(z: zipfile.ZipFile):
    """(index, name, state, part) of every sheet in workbook order."""
    book, rels = _xml(z, "xl/workbook.xml"), _rels(z, "xl/workbook.xml")
    for i, s in enumerate(book.iter(f"{MAIN}sheet"), 1):
        yield i, s.get("name"), s.get("state", "visible"), rels.get(s.get(f"{REL}id"), "")


def _value(kind: str, raw: str | None, shared: list[str], inline: str | None):
    """(text, number, boolean) of one cell."""
    if kind == "inlineStr":
        return inline, None, None
    if raw is None:
        return None, None, None
    if kind == "s":
        i = int(raw)
        return (shared[i] if i < len(shared) else None), None, None
    if kind == "b":
        return None, None, raw == "1"
    if kind in ("str", "e"):
        return raw, None, None
    try:
        return None, float(raw), None
    except ValueError:
        return raw, None, None


def _cells(path: str, payload: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        strings = _xml(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in strings.iter(f"{MAIN}si")] if strings is not None else []
        styles = _xml(z, "xl/styles.xml")
        custom, formats = {}, []
        if styles is not None:
            custom = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter(f"{MAIN}numFmt")}
            xfs = styles.find(f"{MAIN}cellXfs")
            formats = [int(x.get("numFmtId", "0")) for x in xfs] if xfs is not None else []
        for idx, name, state, part in _sheets(z):
            if part not in z.namelist():
                continue
            with z.open(part) as f:
                for _, c in ET.iterparse(f):
                    if c.tag != f"{MAIN}c":
                        if c.tag == f"{MAIN}row":
                            c.clear()
                        continue
                    formula = c.find(f"{MAIN}f")
                    v, inline = c.find(f"{MAIN}v"), c.find(f"{MAIN}is")
                    text = "".join(t.text or "" for t in inline.iter(f"{MAIN}t")) if inline is not None else None
                    s, n, b = _value(c.get("t", "n"), v.text if v is not None else None, shared, text)
                    ftext = formula.text if formula is not None else None
                    if s is None and n is None and b is None and ftext is None:
                        continue
                    style = int(c.get("s", "0"))
                    fid = formats[style] if style < len(formats) else 0
                    yield (path, None, name, idx, state, c.get("r"), s, n, b, ftext, fid, custom.get(fid, BUILTIN_FORMATS.get(fid, "")))


def _charts(path: str, payload: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        for _, name, _, part in _sheets(z):
            for drawing in _rels(z, part).values():
                if "drawings/" not in drawing:
                    continue
                for target in _rels(z, drawing).values():
                    root = _xml(z, target) if "charts/" in target else None
                    if root is None:
                        continue
                    plot = root.find(f".//{CHART}plotArea")
                    kinds = [k for k in CHART_KINDS if plot is not None and plot.find(f"{CHART}{k}Chart") is not None]
                    title = root.find(f".//{CHART}chart/{CHART}title")
                    series = []
                    for ser in root.iter(f"{CHART}ser"):
                        tx = ser.find(f"{CHART}tx")
                        series.append({
                            "title": "".join(x.text or "" for x in tx.iter(f"{CHART}v")) if tx is not None else None,
                            "refs": [x.text for x in ser.iter(f"{CHART}f")], "cached": [x.text for x in ser.iter(f"{CHART}v")]})
                    text = "".join(x.text or "" for x in title.iter(f"{DRAW}t")) if title is not None else None
                    yield (path, None, name, text, kinds[0] if kinds else "unknown", series)


def _job(reader, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, payload in zip(batch["path"], batch["content"]):
                rows: list[tuple] = []
                try:
                    for row in reader(path, payload):
                        rows.append(row)
                        if len(rows) >= 50000:  # one Arrow batch at a time, not the whole file
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except Exception as e:  # a broken file is one rejected row, not a failed job
                    rows.append((path, f"{type(e).__name__}: {e}") + (None,) * (len(columns) - 2))
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return run


def _names(schema: str) -> list[str]:
    return [p.strip().split(" ")[0] for p in schema.split(", ")]


def scan_cells(files: DataFrame) -> DataFrame:
    """One row per populated cell (value or formula); a file that cannot be read gives one error row."""
    raw = files.select("path", "content").mapInPandas(_job(_cells, _names(CELL_SCHEMA)), CELL_SCHEMA)
    row, col = split_ref("ref")
    return raw.select(
        "path", "error", "sheet", "sheet_idx", "state", "ref", row.cast("long").alias("row"), col.cast("long").alias("col"), "value_str", "value_num",
        "value_bool", "formula", C("format_code").alias("number_format"), is_date_format(C("format_id"), C("format_code")).alias("is_date_format"))


def scan_charts(files: DataFrame) -> DataFrame:
    """One row per chart; a file that cannot be read gives one error row."""
    return files.select("path", "content").mapInPandas(_job(_charts, ["path", "error", "sheet", "title", "chart_type", "series"]), CHART_SCHEMA)


def accepted_cells(cells: DataFrame) -> DataFrame:
    """Cells of the files that were read to the end; a file failing half-way gives none."""
    bad = cells.filter("error IS NOT NULL").select("path").distinct()
    return cells.filter("error IS NULL").join(bad, "path", "left_anti").drop("error")


def rejected(cells: DataFrame) -> DataFrame:
    """Sources that failed, with the error type and message."""
    return cells.filter("error IS NOT NULL").select("path", F.split("error", ": ", 2)[0].alias("error_type"), C("error").alias("message"))


def readings(cells: DataFrame) -> DataFrame:
    """Read and rejected counts over the sources."""
    per = cells.groupBy("path").agg(F.bool_or(C("error").isNotNull()).alias("bad"))
    return per.groupBy(F.when(C("bad"), "rejected").otherwise("read").alias("status")).agg(F.count("*").alias("n"))
