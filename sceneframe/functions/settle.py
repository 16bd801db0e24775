"""Work a column out once.

The optimizer copies a column's expression into every later use and into every filter pushed
below it. For a long expression that multiplies work and plan size, so it is generated as a
one-row table instead, which filters are not pushed through.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add ``columns``, each evaluated exactly once per row."""
    made = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made)
