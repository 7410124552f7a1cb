"""Shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.functions.labels import canonical_domain, canonical_lang, canonical_source, source_of_id

from . import bpe

#: Rows of a narrow table that may be broadcast: a few columns, under 16 MB.
BROADCAST_ROWS = 200_000


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def resolved_source(df: DataFrame, source: str, document_index: str | None = None):
    """Canonical source; where that is null the source named in the id; ``unknown`` where both are missing."""
    found = canonical_source(F.col(source))
    if document_index and document_index in df.columns:
        found = F.coalesce(found, canonical_source(source_of_id(F.col(document_index))))
    return F.coalesce(found, F.lit("unknown"))


def sliced(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` with canonical ``source, lang, domain_type``; other columns are left behind."""
    return documents.select(
        "doc_id", "text", resolved_source(documents, "source", "document_index").alias("source"),
        canonical_lang(F.col("lang")).alias("lang"), canonical_domain(F.col("domain_type")).alias("domain_type"),
    )


def token_sizes(df: DataFrame, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` with ``text`` replaced by ``n_tokens BIGINT``; a null or empty text has 0 tokens."""
    keep = [f for f in df.schema.fields if f.name not in ("text", "n_tokens")]
    names = [f.name for f in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", n_tokens bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = bpe.memo(vocabulary)
        for b in batches:
            sizes = pa.array([memo.of(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), sizes], names=[*names, "n_tokens"])

    return df.select(*names, "text").mapInArrow(count, schema)


def hinted(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``BROADCAST_ROWS`` rows; else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
