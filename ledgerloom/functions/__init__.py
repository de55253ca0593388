"""Column expressions shared by the operators."""

from ledgerloom.functions.dates import excel_month, safe_date
from ledgerloom.functions.numeric import (
    finite,
    line_sum,
    ratio,
    running_total,
    total_sum,
)
from ledgerloom.functions.text import (
    as_number,
    canonical_id,
    cell_state,
    clean_text,
    codeish,
    inline_table,
    norm_header,
    slug,
)

__all__ = [
    "as_number", "canonical_id", "cell_state", "clean_text", "codeish", "excel_month",
    "finite", "inline_table", "line_sum", "norm_header", "ratio", "running_total",
    "safe_date", "slug", "total_sum",
]
