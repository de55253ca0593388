"""Form exports: XML, workbook envelopes, HTML and printable text as rows and label/value pairs.

All scans are regular-expression columns over one text per source, so they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import as_number, clean_text
from ledgerloom.functions.text import BLANKS, split_ref

C = F.col
# cp1252 characters of the bytes 0x80-0x9F ('' where the code page has none).
CP1252 = ["€", "", "‚", "ƒ", "„", "…", "†", "‡", "ˆ", "‰", "Š", "‹", "Œ", "", "Ž", "", "", "‘", "’", "“", "”", "•", "–", "—", "˜", "™", "š", "›", "œ", "", "ž", "Ÿ"]
# Known metadata labels, their display form and output order.
METADATA_LABELS = {
    "project sap id": "project sap id",
    "sap project id": "project sap id",
    "project code": "project code",
    "project name": "project name",
    "report start": "report start",
    "report finish": "report finish",
    "project start": "project start",
    "project finish": "project finish",
    "project finish eot": "project finish-EOT",
}
DISPLAY_ORDER = ["project sap id", "project code", "project name", "report start", "report finish", "project start", "project finish", "project finish-EOT"]
LEAF = r"<([\w:.-]+)((?:\s[^<>]*)?)>([^<]*)</\1\s*>"
LINE_PAIR = r"^(.{2,80}?)(?:\s*[:=|\t]\s*|\s{2,})(.+)$"
LINE_BREAK = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"


def decode_text(content: Column) -> Column:
    """UTF-16 by byte-order mark, then UTF-8, then cp1252, then latin-1."""
    head = F.hex(F.substring(content, 1, 2))
    latin = F.decode(content, "ISO-8859-1")
    known = [(chr(0x80 + i), c) for i, c in enumerate(CP1252) if c]
    undefined = "[" + "".join(chr(0x80 + i) for i, c in enumerate(CP1252) if not c) + "]"
    cp = F.translate(latin, "".join(a for a, _ in known), "".join(c for _, c in known))
    utf8 = F.regexp_replace(F.try_validate_utf8(content.cast("string")), "^﻿", "")
    # Every branch is guarded by its test, because a wrong charset is an error, not a NULL.
    wide = F.decode(F.when(head.isin("FFFE", "FEFF"), content), "UTF-16")
    return F.when(head.isin("FFFE", "FEFF"), wide).when(F.is_valid_utf8(content.cast("string")), utf8).when(latin.rlike(undefined), latin).otherwise(cp)


def source_text(files: DataFrame) -> DataFrame:
    return files.select("path", decode_text(C("content")).alias("text"))


def unescape(c: Column) -> Column:
    for name, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(ch))
    return c


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in a start tag, '' when absent."""
    v = F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*("([^"]*)"|'([^']*)')""", 1)
    return unescape(F.substring(v, F.lit(2), F.length(v) - 2))


def xml_root(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"(?s)^(?:\s|\x{FEFF}|<\?.*?\?>|<!--.*?-->|<![^>]*>)*<(?:[\w.-]+:)?([\w.-]+)", 1))


def xml_pairs(sources: DataFrame) -> DataFrame:
    """(name, value) of every non-empty leaf element, in document order."""
    leaves = F.regexp_extract_all("text", F.lit(LEAF), F.lit(0))
    d = sources.select("path", F.posexplode(leaves).alias("ordinal", "leaf"))
    tag = F.regexp_replace(F.regexp_extract("leaf", LEAF, 1), "^.*:", "")
    name = attribute(F.regexp_extract("leaf", LEAF, 2), "name")
    return d.select("path", "ordinal", F.when(name != "", name).otherwise(tag).alias("name"), clean_text(unescape(F.regexp_extract("leaf", LEAF, 3))).alias("value")).filter(
        "value <> ''")


def xml_records(sources: DataFrame) -> DataFrame:
    """One record per element whose children are all leaves: child tags and values in turn."""
    parent = r"<([\w:.-]+)(?:\s[^<>]*)?>\s*((?:<([\w:.-]+)(?:\s[^<>]*)?>[^<]*</\3\s*>\s*)+)</\1\s*>"
    d = sources.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(parent), F.lit(2))).alias("ordinal", "body"))
    leaves = F.regexp_extract_all("body", F.lit(LEAF), F.lit(0))
    cells = F.flatten(F.transform(leaves, lambda x: F.array(
        F.regexp_replace(F.regexp_extract(x, LEAF, 1), "^.*:", ""), F.trim(F.regexp_replace(unescape(F.regexp_extract(x, LEAF, 3)), BLANKS, " ")))))
    return d.select("path", "ordinal", cells.alias("record"))


def valid_forms(sources: DataFrame) -> DataFrame:
    """Sources with the error a wrong root element gives ('.xml' accepts XSF and XDF)."""
    ext, root = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)), xml_root(C("text"))
    error = (
        F.when((ext == "xml") & ~root.isin("XSF", "XDF"), "Unsupported XML input: root must be XSF or XDF")
        .when((ext == "xsf") & (root != "XSF"), "Invalid XSF input: root must be XSF").when((ext == "xdf") & (root != "XDF"), "Invalid XDF input: root must be XDF"))
    return sources.select("path", root.alias("root"), error.alias("error"))


def envelope_cells(sources: DataFrame) -> DataFrame:
    """Cells of SHEET elements: every element with a ref attribute and a value."""
    sheets = sources.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)(<SHEET\b[^>]*>.*?</SHEET\s*>)"), F.lit(1))).alias("i", "body"))
    head = F.regexp_extract("body", r"(?i)^(<SHEET\b[^>]*>)", 1)
    name, state = attribute(head, "name"), attribute(head, "state")
    cell = r"(?i)(<[\w:.-]+\s[^<>]*\bref\s*=\s*[\"'][^<>]*>[^<]*<)"
    d = sheets.select(
        "path", F.when(name != "", name).otherwise(F.concat(F.lit("Sheet "), (C("i") + 1).cast("string"))).alias("sheet"), (C("i") + 1).alias("sheet_idx"),
        F.when(state != "", state).otherwise("visible").alias("state"), F.explode(F.regexp_extract_all("body", F.lit(cell), F.lit(1))).alias("c"))
    ref = F.upper(attribute(C("c"), "ref"))
    value = clean_text(unescape(F.regexp_extract("c", r">([^<]*)<$", 1)))
    row, col = split_ref(ref)
    out = d.select("path", "sheet", "sheet_idx", "state", ref.alias("ref"), row.alias("row"), col.alias("col"), value.alias("raw")).filter("row > 0 AND col > 0 AND raw <> ''")
    number = as_number("raw")
    return out.select("path", "sheet", "sheet_idx", "state", "ref", "row", "col", F.when(number.isNull(), C("raw")).alias("value_str"), number.alias("value_num"))


def envelope_pairs(sources: DataFrame) -> DataFrame:
    """Leaf elements inside METADATA."""
    meta = sources.select("path", F.regexp_extract("text", r"(?is)<METADATA\b[^>]*>(.*?)</METADATA\s*>", 1).alias("text"))
    tags = meta.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(LEAF), F.lit(0))).alias("ordinal", "leaf"))
    return tags.select("path", "ordinal", F.regexp_replace(F.regexp_extract("leaf", LEAF, 1), "^.*:", "").alias("name"),
                       clean_text(unescape(F.regexp_extract("leaf", LEAF, 3))).alias("value")).filter("value <> ''")


def html_rows(sources: DataFrame) -> DataFrame:
    """Table rows as arrays of cell texts; rows without any text are dropped."""
    rows = sources.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1))).alias("ordinal", "body"))
    cells = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), lambda x: F.trim(
        F.regexp_replace(unescape(F.regexp_replace(x, "<[^>]+>", " ")), BLANKS, " ")))
    return rows.select("path", "ordinal", cells.alias("cells")).filter(F.exists("cells", lambda x: x != ""))


def html_fields(sources: DataFrame) -> DataFrame:
    """Field pairs of input/meta tags, data-field attributes and the first two cells of table rows."""
    tags = sources.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?is)(<(?:input|meta)\b[^>]*>)"), F.lit(1))).alias("t"))

    def either(*names: str) -> Column:
        return F.coalesce(*[F.when(attribute(C("t"), rf"(?<![\w-]){n}") != "", attribute(C("t"), rf"(?<![\w-]){n}")) for n in names])

    named = tags.select("path", either("name", "id", "property").alias("name"), either("value", "content").alias("value"))
    data = sources.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?is)(<[a-z][^>]*\bdata-field\b[^>]*>)"), F.lit(1))).alias("t")).select(
        "path", attribute(C("t"), "data-field").alias("name"), attribute(C("t"), "data-value").alias("value"))
    cells = html_rows(sources).filter(F.size("cells") >= 2).select("path", C("cells")[0].alias("name"), C("cells")[1].alias("value"))
    tagged = named.unionByName(data).filter("name IS NOT NULL AND name <> '' AND value IS NOT NULL AND value <> ''")
    return tagged.unionByName(cells)


def text_records(sources: DataFrame) -> DataFrame:
    """Lines of printable text: label/value pairs, or single-column rows (label NULL)."""
    lines = sources.select("path", F.posexplode(F.split(F.regexp_replace("text", r"\x{00}", ""), LINE_BREAK)).alias("line", "raw"))
    line = clean_text(F.regexp_replace("raw", r"[\p{C}\p{Z}]", " "))
    d = lines.select("path", "line", line.alias("t")).filter("t <> ''")
    # one pass of the pattern: label and value around a mark that the cleaned text cannot hold
    split = d.select("path", "line", "t", F.split(F.regexp_replace("t", LINE_PAIR, "$1\u0000$2"), "\u0000").alias("p"))
    pair = F.size("p") == 2
    return split.select("path", "line", F.when(pair, clean_text(F.get("p", F.lit(0)))).alias("label"), F.when(pair, clean_text(F.get("p", F.lit(1)))).otherwise(C("t")).alias("value"))


def field_label(c: Column) -> Column:
    """Label with camel case split and separators as blanks, case-folded."""
    s = F.regexp_replace(clean_text(c), "([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(clean_text(F.regexp_replace(s, r"[._/\\:-]+", " ")))


def metadata_rows(pairs: DataFrame) -> DataFrame:
    """Known metadata of each source: exact or suffix label match, first non-empty value, fixed order.

    ``pairs`` has path, ordinal, name, value.
    """
    label = field_label(C("name"))
    display = F.lit(None).cast("string")
    for known, shown in reversed(list(METADATA_LABELS.items())):
        display = F.when(label.endswith(" " + known), shown).otherwise(display)
    for known, shown in METADATA_LABELS.items():
        display = F.when(label == known, shown).otherwise(display)
    d = pairs.select("path", "ordinal", display.alias("display"), "value").filter((clean_text("value") != "") & C("display").isNotNull())
    order = F.array_position(F.array(*[F.lit(x) for x in DISPLAY_ORDER]), C("display"))
    return d.groupBy("path", "display").agg(F.min_by("value", "ordinal").alias("value")).withColumn("position", order)
