"""Importing this module registers every query."""

from checks import catalog, films, texts, validate  # noqa: F401
from checks import activity  # noqa: F401  (after the queries it shares oracles with)
from checks.registry import ORACLES, QUERIES  # noqa: F401
