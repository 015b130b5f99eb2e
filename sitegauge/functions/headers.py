"""Response header lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header(headers: Column, name: str) -> Column:
    """Value of the first header of that name, ignoring case; null if there is none."""
    hits = F.map_filter(headers, lambda k, _: F.lower(k) == name)
    return F.get(F.map_values(hits), F.lit(0))
