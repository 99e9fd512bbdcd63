"""Words of a text, the same in Python tasks and in SQL expressions.

A word is a run of characters other than the six ASCII white-space characters. Python's
``bytes.split`` splits at exactly these, and ``bytes.lower`` changes A-Z only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def split(text: str | None) -> list[bytes]:
    """Words of ``text`` in order; none for null."""
    return text.encode().split() if text else []


def count(text: Column | str) -> Column:
    """Number of words (long), 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
