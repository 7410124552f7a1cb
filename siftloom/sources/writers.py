"""Writers: Parquet, JSON lines, shards, cells, archives and results."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output stands at the path: its ``_SUCCESS`` mark on any file system Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: Rows of a file of a shard.
ROWS_PER_FILE = 1_000_000
#: Shards written before they are marked finished.
SHARDS_PER_JOB = 64


def _mark(spark: SparkSession, path: str) -> None:
    """Leaves the mark of a finished output."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()


def write_parquet(df: DataFrame, path: str, files: int | None = None, codec: str = "zstd", level: int = 3, skip_done: bool = False) -> bool:
    """Parquet with a codec; ``files`` of even size if given. Returns whether it wrote; a finished output can be left alone."""
    if skip_done and exists(df.sparkSession, path):
        return False
    out = df if files is None else df.repartition(files)
    out.write.mode("overwrite").option("compression", codec).option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    return True


def write_jsonl(df: DataFrame, path: str, files: int | None = None, skip_done: bool = False) -> bool:
    """JSON lines, non-ASCII text as it is."""
    if skip_done and exists(df.sparkSession, path):
        return False
    (df if files is None else df.repartition(files)).write.mode("overwrite").json(path)
    return True


def write_shards(df: DataFrame, path: str, shard: str = "shard", skip_done: bool = True) -> bool:
    """One folder a shard, of files of up to ``ROWS_PER_FILE`` rows; a large shard is written by several tasks.

    With ``skip_done`` a finished output is left as it is, and of a broken one the shards
    that are marked finished: ``SHARDS_PER_JOB`` at a time are written and then marked. A
    null shard is not written.
    """
    spark = df.sparkSession
    if skip_done and exists(spark, path):
        return False
    sizes = [(r[shard], r.n) for r in df.where(F.col(shard).isNotNull()).groupBy(shard).agg(F.count("*").alias("n")).orderBy(shard).collect()]
    missing = [(k, n) for k, n in sizes if not (skip_done and exists(spark, f"{path}/{shard}={k}"))]
    plain = [F.col(c) for c, t in df.dtypes if c != shard and "map<" not in t] or [F.lit(0)]
    for first in range(0, len(missing), SHARDS_PER_JOB):
        part = missing[first : first + SHARDS_PER_JOB]
        pieces = F.create_map(*[F.lit(x) for k, n in part for x in (str(k), -(-n // ROWS_PER_FILE))])
        salt = F.pmod(F.xxhash64(*plain), F.try_element_at(pieces, F.col(shard).cast("string")).cast("long"))
        rows = df.where(F.col(shard).cast("string").isin([str(k) for k, _ in part])).withColumn("_piece", salt)
        files = sum(-(-n // ROWS_PER_FILE) for _, n in part)
        out = rows.repartition(files, shard, "_piece").drop("_piece")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(shard).parquet(path)
        for k, _ in part:
            _mark(spark, f"{path}/{shard}={k}")
    _mark(spark, path)
    return True


def write_cells(df: DataFrame, path: str, source: str, metrics: Sequence[str]) -> None:
    """Each (criterion, source, value) cell as a folder of its own in one pass; cells without rows don't come up."""
    cells = df.select("*", F.explode(F.array(*[F.struct(F.lit(m).alias("criterion"), F.col(m).cast("string").alias("value")) for m in metrics])).alias("_cell"))
    wide = cells.where("_cell.value is not null").select(*df.columns, "_cell.criterion", "_cell.value")
    wide.write.mode("overwrite").partitionBy("criterion", source, "value").parquet(path)


def split_valid(df: DataFrame, path: str, valid) -> None:
    """Rows that pass and rows that fail, in one pass, as ``<path>/outcome=success`` and ``<path>/outcome=failed``."""
    df.withColumn("outcome", F.when(F.coalesce(valid, F.lit(False)), "success").otherwise("failed")).write.mode("overwrite").partitionBy("outcome").parquet(path)


def write_archive(df: DataFrame, path: str, text: str = "text", meta: str | None = None, level: int = 3) -> None:
    """zstd-compressed JSON lines of ``text, meta``, one frame a batch: each task writes one binary file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        for pdf in batches:
            metas = pdf[meta] if meta else [None] * len(pdf)
            lines = "".join(json.dumps({"text": t, "meta": json.loads(m) if isinstance(m, str) else {}}, ensure_ascii=False) + "\n" for t, m in zip(pdf[text], metas))
            yield pd.DataFrame({"frame": [zstandard.ZstdCompressor(level=level).compress(lines.encode())]})

    columns = [text] + ([meta] if meta else [])
    frames = df.select(*columns).mapInPandas(run, "frame binary")
    frames.write.mode("overwrite").parquet(path)


def export_archive(spark: SparkSession, frames: str, folder: str) -> int:
    """The frames of ``write_archive`` as plain ``part-<n>.jsonl.zst`` files on a shared folder; returns their number."""
    import os

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        os.makedirs(folder, exist_ok=True)
        temporary = f"{folder}/.part-{part:05d}-{TaskContext.get().taskAttemptId()}"
        with open(temporary, "wb") as f:
            for pdf in batches:
                for frame in pdf["frame"]:
                    f.write(frame)
        os.replace(temporary, f"{folder}/part-{part:05d}.jsonl.zst")
        yield pd.DataFrame({"part": [part]})

    return spark.read.parquet(frames).mapInPandas(run, "part int").count()


def write_buckets(lines: DataFrame, path: str, ngram: str, key: str, buckets: int, codec: str = "gzip") -> None:
    """Text lines ``<ngram> <key>`` in ``bucket=<n>`` folders by a stable hash of the n-gram, sorted in each, compressed by ``codec``.

    One shuffle by bucket and n-gram range; a bucket is written by as many tasks as its lines
    fill, each in order, so that equal n-grams follow each other in one file.
    """
    bucket = F.pmod(F.xxhash64(ngram), F.lit(buckets)).cast("int")
    rows = lines.select(bucket.alias("bucket"), F.concat_ws(" ", F.col(ngram), F.col(key).cast("string")).alias("value"), F.col(ngram).alias("_g"))
    ordered = rows.repartitionByRange("bucket", "_g").sortWithinPartitions("bucket", "value").drop("_g")
    ordered.write.mode("overwrite").option("compression", codec).partitionBy("bucket").text(path)


def results_digest(df: DataFrame, key: str, columns: Sequence[str]) -> str:
    """One SHA-256 over all rows: the digests of the rows fall into ranges of their own value, each range is digested in order, then the ranges.

    Only digests are shuffled; a range holds about a 65,536th of them. Equal rows count each time.
    """
    one = df.select(F.sha2(F.to_json(F.struct(key, *columns), {"ignoreNullFields": "false"}), 256).alias("h"))
    ranges = one.groupBy(F.substring("h", 1, 4).alias("r")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return ranges.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "h"))), lambda s: s["h"]), ""), 256)).first()[0]


def write_results(df: DataFrame, path: str) -> None:
    """Aggregated results as one JSON file; results have one row a task and metric."""
    df.coalesce(1).write.mode("overwrite").json(path)
