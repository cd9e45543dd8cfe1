"""Binding a value once inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it.

    Higher-order functions are not covered by common-subexpression elimination, so an
    expression used inside a lambda would otherwise run again for every element.
    """
    return F.transform(F.array(value), body)[0]
