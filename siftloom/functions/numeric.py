"""Arithmetic that stays defined where a divisor is 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def draw(*parts: Column) -> Column:
    """A number of 60 bits that depends on the parts alone: the first digits of their MD5, which other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """``draw`` for DuckDB."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


def correlation(x: Column, y: Column) -> Column:
    """Pearson over the rows where neither is null; null where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.max(a) > F.min(a), F.when(F.max(b) > F.min(b), ratio(F.covar_pop(a, b), spread)))
