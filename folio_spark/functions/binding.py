"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column referenced inside a lambda is evaluated again for every element;
    binding it to a lambda variable first keeps per-row work linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
