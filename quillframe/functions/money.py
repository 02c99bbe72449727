"""Amounts, percentages and their display."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_NUMBER = r"([0-9]+(?:[.,][0-9]+)?)"


def amount(x: Column) -> Column:
    """First number of the text (ASCII spaces removed, comma as point) with two decimals, as a string; null if there is none.

    Further decimals are rounded half to even on the decimal text; amount_exact() rounds the binary value.
    """
    found = F.regexp_extract(F.replace(x.cast("string"), F.lit(" "), F.lit("")), _NUMBER, 1)
    number = F.replace(F.nullif(found, F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(38,12)")
    return F.bround(number, 2).cast("decimal(38,2)").cast("string")


percentage = amount


@F.pandas_udf(StringType())
def amount_exact(xs: pd.Series) -> pd.Series:
    """As amount(), rounded as the nearest double's exact value, for inputs of more than two decimals."""
    find = re.compile(_NUMBER)

    def one(x: str | None) -> str | None:
        m = find.search(x.replace(" ", "")) if x is not None else None
        return f"{float(m[1].replace(',', '.')):.2f}" if m else None

    return xs.map(one)


def rate(x: Column) -> Column:
    """A percentage string as a share: over 1 it is taken for per cent."""
    v = x.try_cast("double")
    return F.when(v > 1, v / 100).otherwise(v)


def as_percentage(x: Column) -> Column:
    """With a no-break space: 0.2 as `20 %`, 0.055 as `5.5 %`; null for null and 0."""
    v = F.round(x * 100, 6)
    shown = F.when(v == F.floor(v), F.format_string("%d", v.cast("long"))).otherwise(F.format_string("%.1f", v))
    return F.when(F.coalesce(x, F.lit(0.0)) != 0, F.concat(shown, F.lit("\u00a0%")))


def ratio_text(x: Column) -> Column:
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))
