"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once and present once in the plan.

    Steps that mention their input several times would otherwise multiply
    when Catalyst substitutes aliases, for instance to push a filter down.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
