"""Column plumbing."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` evaluated once.

    Catalyst does not share sub-expressions inside lambdas: a value that a lambda refers to would
    be computed again for every element. Bound as the variable of a one-element ``transform``
    it is computed once per row.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))
