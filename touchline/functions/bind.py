"""Binding a value in a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once.

    A function over an array evaluates everything it refers to for each element; what it refers to through here is held.
    """
    return F.transform(F.array(value), body)[0]
