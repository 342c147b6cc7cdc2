"""Ranges of a sorted key, small enough for one task each, and running sums over all of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a range, and the most ranges made, which bounds what a plan holds; rows looked at for each range, which bounds what the driver reads.
RANGE_ROWS, MOST_RANGES, LOOKED_AT = 2048, 1 << 16, 32


def bounds(rows: DataFrame, name: str, range_rows: int = RANGE_ROWS) -> list[int]:
    """Distinct values of an integer column that cut it into ranges of about as many rows, from a sample of all rows."""
    total = rows.count()
    n = min(MOST_RANGES, total // range_rows + 1)
    if n == 1:
        return []
    few = rows.where(F.col(name).isNotNull()).select(F.col(name).cast("long").alias(name))
    share = LOOKED_AT * n / total
    found = np.sort((few.sample(fraction=share, seed=1) if share < 0.5 else few).toArrow().column(name).to_numpy())
    return np.unique(found[np.arange(1, n) * len(found) // n]).tolist() if len(found) else []


def held(values: list[int]) -> Column:
    """Integers as one constant, which a plan holds as short text."""
    return F.from_json(F.lit(str(values)), "array<bigint>")


def range_of(name: str, cuts: list[int]) -> Column:
    """How many of the sorted values lie below the column's, by binary search; null: 0."""
    if not cuts:
        return F.lit(0)
    values = held(cuts)

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.coalesce(F.get(values, at + step - 1) < F.col(name), F.lit(False)), at + step).otherwise(at)

    steps = range(len(cuts).bit_length())
    return F.aggregate(F.array(*(F.lit(1 << k) for k in reversed(steps))), F.lit(0), halve)
