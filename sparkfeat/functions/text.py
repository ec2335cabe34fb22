"""Text clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_split(value: Column, delimiter: str) -> Column:
    """Split on the delimiter itself, never as a regular expression."""
    return F.split(value, r"\Q" + delimiter + r"\E")


def first_parts(value: Column, delimiter: str, parts: int) -> Column:
    """The first ``parts`` pieces joined with ``_``; undivided text and NULL stay as they are."""
    pieces = literal_split(value, delimiter)
    return F.when(F.size(pieces) > 1, F.array_join(F.slice(pieces, 1, parts), "_")).otherwise(value)


def sku_family(value: Column) -> Column:
    """``SERVER`` wherever it occurs, else the first four characters; ``PRO_`` reads ``PROF``."""
    head = F.when(value.contains("SERVER"), F.lit("SERVER")).otherwise(F.substring(value, 1, 4))
    return F.when(head == "PRO_", F.lit("PROF")).otherwise(head)


def contains_flag(value: Column, needle: str) -> Column:
    """1 where the lower-cased text contains ``needle``; 0 elsewhere, NULL included."""
    return F.coalesce(F.lower(value.cast("string")).contains(needle), F.lit(False)).cast("int")
