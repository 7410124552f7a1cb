"""Running totals that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftloom.session import checkpointed


#: Rows of a table of a few columns that may be broadcast.
BROADCAST_ROWS = 200_000


def running_total(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name in ``values``, the inclusive running total of its column along ``order`` within ``by``.

    Rows are range-partitioned by (``by``, ``order``), totals of the ranges give each range
    its offset, and a window runs inside one range only; a group that holds a third of
    all rows is spread over as many tasks as any other third. ``order`` must be total for
    a defined result. Nulls count as 0; null groups are one group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in values.items()})
    ranged = checkpointed(df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in by], *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = checkpointed(totals.select(
        *[F.col(c).alias(f"_k_{c}") for c in by], F.col("_range").alias("_k"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values]
    ))
    local = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumns({f"_c_{k}": F.sum(f"_v_{k}").over(local) for k in values})
    same = F.col("_range") == F.col("_k")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    joined = inside.join(F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets, same)
    kept = [c for c in df.columns if not c.startswith("_v_")]
    return joined.select(*kept, *[(F.col(f"_c_{k}") + F.col(f"_o_{k}")).alias(k) for k in values])
