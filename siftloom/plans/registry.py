"""Where plans register their query and the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftloom.functions.labels import METRICS, canonical_domain, canonical_domain_sql, canonical_source, canonical_source_sql, rating, rating_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rated(spark: SparkSession, d: str) -> DataFrame:
    """The rating table typed: the latest delivery of each line, labels in canonical form, ratings as integers or null."""
    a = table(spark, d, "annotated")
    latest = Window.partitionBy("document_index").orderBy(F.col("annotated_at").desc_nulls_last(), F.col("loaded_at").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("overall_score", "length")])
    return a.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select(
        "document_index", canonical_source(F.col("source_domain")).alias("source_domain"), "length", canonical_domain(F.col("application_domain")).alias("application_domain"),
        *[rating(F.col(m)).alias(m) for m in METRICS],
    )


RATED = f"""rated AS (
    SELECT document_index, {canonical_source_sql("source_domain")} AS source_domain, length, {canonical_domain_sql("application_domain")} AS application_domain,
           {", ".join(f"{rating_sql(m)} AS {m}" for m in METRICS)}
    FROM (SELECT *, row_number() OVER (PARTITION BY document_index ORDER BY annotated_at DESC NULLS LAST, loaded_at DESC NULLS LAST,
                                       overall_score ASC NULLS LAST, length ASC NULLS LAST) AS _n FROM annotated)
    WHERE _n = 1
)"""


def stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics rows with metrics outside 1 to 5 and NaN as null."""
    s = table(spark, d, "sft_stats")
    return s.select("sample_index", "source", "category", *[F.when((F.col(m) >= 1) & (F.col(m) <= 5), F.col(m)).alias(m) for m in METRICS])


STATS = f"""stats AS (SELECT sample_index, source, category, {", ".join(f"CASE WHEN {m} >= 1 AND {m} <= 5 AND NOT isnan({m}) THEN {m} END AS {m}" for m in METRICS)} FROM sft_stats)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for a comparison between engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
