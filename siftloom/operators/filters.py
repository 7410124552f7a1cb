"""Row and column filters, validity checks and audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.labels import valid_rating


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns in their order; names that are absent are ignored."""
    return df.select(*[c for c in columns if c in df.columns])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def rename_columns(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def field(df: DataFrame, path: str) -> Column:
    """A column, or a nested field by its dotted path."""
    return F.col(path) if path in df.columns or "." not in path else F.col(path.split(".")[0])[path.split(".", 1)[1]] if path.count(".") == 1 else F.col(path)


def equals_five(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) == "5")


def all_valid(columns: Sequence[str]) -> Column:
    """Whether every listed rating is a whole number 1 to 5 in ASCII digits; null and blank are not."""
    return reduce(Column.__and__, [valid_rating(F.col(c)) for c in columns])


def failed_columns(columns: Sequence[str]) -> Column:
    """Names of the ratings that are not valid."""
    return F.filter(F.array(*[F.when(~valid_rating(F.col(c)), F.lit(c)) for c in columns]), lambda c: c.isNotNull())


def audit_ids(df: DataFrame, number: Column) -> DataFrame:
    """One row: ``n, n_distinct, greatest, complete``; complete means the numbers are exactly 1 to n."""
    out = df.select(number.alias("i")).agg(F.count("*").alias("n"), F.countDistinct("i").alias("n_distinct"), F.max("i").alias("greatest"))
    return out.withColumn("complete", F.coalesce((F.col("n") == F.col("n_distinct")) & (F.col("n") == F.col("greatest")), F.col("n") == 0))


def audit_sources(df: DataFrame, by: Column, number: Column) -> DataFrame:
    """``audit_ids`` of each source: ``source, n, n_distinct, greatest, missing``."""
    out = df.select(by.alias("source"), number.alias("i")).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("i").alias("n_distinct"), F.max("i").alias("greatest"))
    return out.withColumn("missing", F.col("greatest") - F.col("n_distinct"))


def within_tokens(df: DataFrame, text: str, counters: Sequence[Callable[[Column], Column]], most: int) -> DataFrame:
    """Rows whose text has at most ``most`` tokens by every counter. Each distinct text is counted once."""
    ok = reduce(Column.__and__, [c(F.col(text)) <= most for c in counters])
    good = df.select(text).distinct().where(ok)
    return df.join(good, text, "left_semi")
