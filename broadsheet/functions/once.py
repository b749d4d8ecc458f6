"""Compute costly columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns, held by a one-row generator.

    A filter over a plain projection is moved below it, and the projection's expressions
    are then repeated wherever the filter uses them. A generator stops that.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(made)))
