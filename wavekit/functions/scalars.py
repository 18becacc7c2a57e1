"""Attach one-row statistics (means, medians, totals, quantile edges) to a frame as typed literals.

The statistics row is the result of a global aggregate — one row by construction — so taking it to the
driver is bounded; the frame then carries plain constants (no cross join, codegen sees literals).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(stats: DataFrame) -> dict:
    rows = stats.take(2)
    if len(rows) != 1:
        raise ValueError(f"expected a one-row statistics table, got {len(rows)} rows")
    return rows[0].asDict()


def literals(stats: DataFrame) -> dict[str, Column]:
    """{column: typed literal} for the single row of ``stats``."""
    row = one_row(stats)
    return {f.name: F.lit(row[f.name]).cast(f.dataType) for f in stats.schema.fields}


def attach(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` with every column of the one-row ``stats`` table added as a constant column."""
    return df.withColumns(literals(stats))
