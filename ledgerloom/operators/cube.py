"""A lattice of grouped measures from one pass over the lines.

Groupings that share lines are asked for together: one scan expands each line to the levels, map-side combine folds them
before the single shuffle, and the cells are written as Parquet, one folder per level. Every further grouping reads cells.
A level is the finest grain its readers need, so the size of the table is that of its cells and not of the lines.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import line_sum
from ledgerloom.session import written


def measure_cube(lines: DataFrame, levels: Mapping[str, Sequence[str]], measures: Sequence[str], name: str = "cells") -> dict[str, DataFrame]:
    """A table per level: its keys, ``n`` (lines of the cell) and the exact sums of ``measures``.

    Cells stand in for lines in every sum, maximum or distinct over their keys. A null key is a cell of its own, as in any
    grouping; the level of a cell comes from the grouping id and never from its nulls. A measure without a value in a cell is
    NULL. An empty table gives empty levels. Further columns of ``lines``, whatever their names, are not read.
    """
    if not levels:
        return {}
    keys = list(dict.fromkeys(k for level in levels.values() for k in level))
    sums = [F.count(F.lit(1)).alias("n"), *[line_sum(m).alias(m) for m in measures]]
    used = lines.select(*keys, *measures)
    if len(levels) == 1:
        (only, own), = levels.items()
        return {only: written(used.groupBy(*own).agg(*sums), name)}
    ids = {}
    for level, own in levels.items():
        mask = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in own)
        if mask in ids:
            raise ValueError(f"levels {ids[mask]} and {level} have the same keys")
        ids[mask] = level
    cells = used.groupingSets([[F.col(k) for k in own] for own in levels.values()], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_id"), *sums)
    names = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    table = written(cells.withColumn("level", F.element_at(names, F.col("_id").cast("int"))).drop("_id"), name, "level")
    return {level: table.filter(F.col("level") == level).select(*own, "n", *measures) for level, own in levels.items()}
