"""A value with a name inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once and written into the plan once, however often the body looks at it. Neither may hold a Python function in the body."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))  # transform looks at the number of parameters
