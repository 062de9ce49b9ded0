"""Names for helper columns that no column of the input has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_prefix(docs: DataFrame, prefix: str) -> str:
    """``prefix``, lengthened until no column of ``docs`` starts with it, whatever its case."""
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix += "_"
    return prefix
