"""A value that is computed once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value): a lambda's argument is bound, where a repeated expression would be evaluated at each use."""
    return F.transform(F.array(value), body)[0]
