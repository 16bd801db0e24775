"""Numbers written as text, read by one grammar everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits with at most one point and an exponent, or one of the three words; nothing else, so no
#: type letters, no hexadecimal and no white space, which a cast would take.
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
WORDS = r"(?i:[+-]?(?:inf|infinity|nan))"


def plain_number(text: Column) -> Column:
    """The number that the whole text is, else null."""
    return (
        F.when(text.rlike(rf"\A{NUMBER}\z"), text.try_cast("double"))
        .when(text.rlike(rf"\A{WORDS}\z"), F.when(F.lower(text).contains("nan"), float("nan")).when(text.startswith("-"), float("-inf")).otherwise(float("inf")))
    )
