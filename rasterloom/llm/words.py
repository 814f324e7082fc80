"""Words are runs of anything but ASCII white space: ``[^\\x20\\x09-\\x0D]+``.

The JVM forms below and ``bytes.split()`` in the Python kernels cut at the same
six bytes, so both give the same words for every text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_array(text: Column) -> Column:
    """The words in order; an empty array for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")
