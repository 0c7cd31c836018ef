"""Column names that clash with none of a frame's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores before it until ``df`` has no column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish
