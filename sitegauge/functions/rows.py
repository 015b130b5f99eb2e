"""Array column to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inline_rows(df: DataFrame, keep: list, items: str | Column, not_null: str) -> DataFrame:
    """One row per struct in the array ``items``.

    The outer form plus a filter on the result: with the plain form the optimizer puts a size
    check below the generator, and a computed array would be worked out twice per row.
    """
    return df.select(*keep, F.inline_outer(items)).filter(F.col(not_null).isNotNull())


def explode_rows(df: DataFrame, keep: list, items: str | Column, name: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, keep: list, items: str | Column, pos: str, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(items).alias(pos, name)).filter(F.col(name).isNotNull())


def keep_where(df: DataFrame, columns: list, condition: str) -> DataFrame:
    """Select ``columns`` and keep rows by a condition on the results.

    A plain filter would be pushed below the projection together with the expressions it
    names, and html would be matched twice. Rows that pass through a generator are only
    filtered after it.
    """
    return df.select(F.inline_outer(F.array(F.struct(*columns)))).filter(condition)
