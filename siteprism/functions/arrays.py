"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where it is used for each of many items."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def first_of_each(items: Column, key: Callable[[Column], Column]) -> Column:
    """Of items in an order in which those of one key lie together, the first of each key."""
    return let(items, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (key(x) != key(F.get(xs, i - 1)))))
