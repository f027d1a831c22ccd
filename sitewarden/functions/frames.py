"""DataFrame helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``withColumns`` for costly expressions that later filters use.

    A plain projection would be expanded again inside every filter pushed below it, and inside join conditions;
    inlining a struct keeps each expression where it is, evaluated once per row.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(F.inline(F.array(F.struct(*kept, *[c.alias(n) for n, c in columns.items()]))))
