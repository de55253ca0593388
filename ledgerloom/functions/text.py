"""Text normalisation, numeric coercion and cell predicates."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters treated as blanks, error tokens, code patterns.
BLANKS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
ERROR_TOKENS = ["#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#N/A"]
CODE_PATTERNS = [
    r"^[A-Za-z]+(?:[.\-/][A-Za-z0-9]+)+$",
    r"^[A-Za-z]+[.\-/]?[0-9][A-Za-z0-9.\-/]*$",
    r"^[A-Za-z]?\d+(?:[.\-/]\d+){1,}$",
]
HEADER_PUNCTUATION = r"[#%()\[\]{}:_/\\.\-]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def inline_table(spark: SparkSession, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """A small dictionary as a literal relation: its size is known to the optimizer."""
    from datetime import date

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return f"{v!r}D"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, date):
            return f"DATE'{v.isoformat()}'"
        return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def clean_text(c: Column | str) -> Column:
    """Collapse every run of blanks to one space and trim; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), BLANKS, " "))


@F.pandas_udf(T.StringType())
def _fold_nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


@F.pandas_udf(T.StringType())
def _slug_nfkd(s: pd.Series) -> pd.Series:
    """NFKD keeps ASCII as it is and takes other characters one by one as far as ASCII goes, so only runs of these are folded, each once a batch."""
    letters = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))
    seen: dict = {}

    def plain(m) -> str:
        if m[0] not in seen:
            seen[m[0]] = unicodedata.normalize("NFKD", m[0]).encode("ascii", "ignore").decode("ascii")
        return seen[m[0]]

    def one(v):
        if v is None:
            return None
        text = v if v.isascii() else re.sub(r"[^\x00-\x7F]+", plain, v)
        return b"-".join(text.encode("ascii").translate(letters).split()).decode("ascii")

    return s.map(one)


def casefold(c: Column, unicode_fold: bool) -> Column:
    return _fold_nfkc(c) if unicode_fold else F.lower(c)


def norm_header(c: Column | str, unicode_fold: bool = False) -> Column:
    """Header normal form: case-folded, punctuation to blanks, blanks collapsed."""
    text = F.regexp_replace(casefold(clean_text(c), unicode_fold), HEADER_PUNCTUATION, " ")
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def slug(c: Column | str, unicode_fold: bool = False) -> Column:
    """Hyphenated ASCII name; 'project' when nothing is left."""
    c = _col(c)
    out = _slug_nfkd(c) if unicode_fold else F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(out == "", F.lit("project")).otherwise(F.coalesce(out, F.lit("project")))


def canonical_id(c: Column | str, unicode_fold: bool = False) -> Column:
    """Lookup key of an identifier: trimmed, blanks collapsed, case-folded."""
    return casefold(clean_text(c), unicode_fold)


def as_number(c: Column | str) -> Column:
    """Plain signed decimal text to double; anything else is NULL."""
    s = F.regexp_replace(F.trim(F.regexp_replace(_col(c), r"^[\s]+|[\s]+$", "")), r",|EGP|\$|%", "")
    return F.when(s.rlike(r"^[-+]?\d+(?:\.\d+)?$"), s.try_cast("double"))


def codeish(c: Column | str) -> Column:
    """True when the text looks like a work code."""
    t = clean_text(c)
    matches = F.lit(False)
    for p in CODE_PATTERNS:
        matches = matches | t.rlike(p)
    return (t != "") & ~t.startswith("#") & (F.length(t) <= 80) & matches


def cell_state(c: Column | str) -> Column:
    """missing / formula_error / value."""
    c = _col(c)
    return (
        F.when(c.isNull() | (c == ""), F.lit("missing"))
        .when(F.upper(F.trim(c)).isin(ERROR_TOKENS), F.lit("formula_error"))
        .otherwise(F.lit("value"))
    )


def column_number(letters: Column) -> Column:
    """Spreadsheet column letters to a number (A=1, Z=26, AA=27)."""
    chars = F.split(F.upper(letters), "")
    return F.aggregate(
        F.filter(chars, lambda x: x != ""),
        F.lit(0),
        lambda acc, x: acc * 26 + F.ascii(x) - 64,
    )


def split_ref(ref: Column | str) -> tuple[Column, Column]:
    """(row, col) of a cell reference; (0, 0) when it is not one."""
    u = F.upper(_col(ref))
    letters = F.regexp_extract(u, r"^([A-Z]+)(\d+)", 1)
    digits = F.regexp_extract(u, r"^([A-Z]+)(\d+)", 2)
    ok = letters != ""
    return (
        F.when(ok, digits.try_cast("int")).otherwise(F.lit(0)),
        F.when(ok, column_number(letters)).otherwise(F.lit(0)),
    )


def column_letters(n: Column) -> Column:
    """Column number to letters, up to four letters; 0 gives 'A'."""
    n = n.cast("long")
    d1 = F.pmod(n - 1, F.lit(26))
    r1 = F.floor((n - 1) / 26)
    d2 = F.pmod(r1 - 1, F.lit(26))
    r2 = F.floor((r1 - 1) / 26)
    d3 = F.pmod(r2 - 1, F.lit(26))
    r3 = F.floor((r2 - 1) / 26)
    d4 = F.pmod(r3 - 1, F.lit(26))

    def ch(d):
        return F.char(d + 65)

    return (
        F.when(n <= 0, F.lit("A"))
        .when(r1 <= 0, ch(d1))
        .when(r2 <= 0, F.concat(ch(d2), ch(d1)))
        .when(r3 <= 0, F.concat(ch(d3), ch(d2), ch(d1)))
        .otherwise(F.concat(ch(d4), ch(d3), ch(d2), ch(d1)))
    )
