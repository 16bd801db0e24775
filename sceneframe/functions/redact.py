"""Column functions that take secrets out of text before it is written anywhere."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneframe.constants import REDACTED, SECRET_MARKERS
from sceneframe.functions.text import SPACES

_ANY_MARKER = "(?i)" + "|".join(re.escape(m.strip()) for m in SECRET_MARKERS)
_PUNCTUATION = r"""["',;()\[\]{}]*"""
_TOKEN = rf"(?<![^{SPACES}]){_PUNCTUATION}[A-Za-z0-9_+\-]{{32,}}{_PUNCTUATION}(?![^{SPACES}])"


def is_secret_key(name: Column) -> Column:
    return name.rlike(_ANY_MARKER)


def _named(line: Column) -> Column:
    """A named secret takes the rest of the line; the first marker of the list that fits wins.

    Only a line feed ends a line: carriage returns and the other line ends of Unicode stay
    inside it, so what stands behind them goes as well.
    """
    out = F.regexp_replace(line, _TOKEN, REDACTED)
    for marker in reversed(SECRET_MARKERS):
        m = re.escape(marker)
        if marker.endswith(" "):
            # The value follows the marker itself when no separator does.
            out = F.when(line.rlike(f"(?i){m}"), F.regexp_replace(line, f"(?is)\\A(.*?{m}).*\\z", f"$1{REDACTED}")).otherwise(out)
        out = F.when(
            line.rlike(f"(?i){m}[^=:]*[=:]"), F.regexp_replace(line, f"(?is)\\A(.*?{m}[^=:]*[=:]).*\\z", f"$1{REDACTED}")
        ).otherwise(out)
    return out


def redact(text: Column) -> Column:
    """Named secrets and long opaque tokens out, line by line.

    The thirteen markers are only looked for line by line in texts that hold one at all.
    """
    plain = F.regexp_replace(text, "\r\n", "\n")
    lines = F.transform(F.split(plain, "\n"), lambda line: F.when(line.rlike(_ANY_MARKER), _named(line)).otherwise(F.regexp_replace(line, _TOKEN, REDACTED)))
    return F.when(plain.rlike(_ANY_MARKER), F.array_join(lines, "\n")).otherwise(F.regexp_replace(plain, _TOKEN, REDACTED))


def redact_fields(fields: Column) -> Column:
    return F.transform_values(fields, lambda k, v: F.when(is_secret_key(k), F.lit(REDACTED)).otherwise(redact(v)))


_NUMBER = r"(?i)^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)$"


def defuse(value: Column) -> Column:
    """A cell a spreadsheet would run as a formula gets a quote in front; numbers do not."""
    return F.when(value.rlike(r"^[=+\-@\t\r]") & ~value.rlike(_NUMBER), F.concat(F.lit("'"), value)).otherwise(value)


def csv_cell(value: Column) -> Column:
    return defuse(F.regexp_replace(value, "[\r\n]", " "))


def join_fields(fields: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
