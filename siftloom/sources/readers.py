"""Readers: JSON lines, tab-separated perplexity lines, Parquet, compressed archives, benchmark splits."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import DOCUMENT, FORMATS, RESPONSE


def source_of_path(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def _with_nulls(df: DataFrame, wanted: str) -> DataFrame:
    """``df`` with the top-level columns of a schema string that it lacks, as typed nulls."""
    schema = df.sparkSession.createDataFrame([], wanted).schema
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns})


def canonical(df: DataFrame, form: str, path: Column | None = None) -> DataFrame:
    """``text, source_domain, ppl, quality_score`` of any input form; absent fields are null.

    Text is the first of ``text, content, txt``. The source is the field of the form (set
    names without their prefix), or the file name from ``path``.
    """
    every = "text string, content string, txt string, source string, ppl double, quality_score double, source_domain string"
    wide = _with_nulls(df, every)
    sources = {
        "slimpajama": lambda: F.regexp_replace(F.col("meta.redpajama_set_name"), "RedPajama", ""),
        "ChineseWebText2": lambda: F.col("domain.single_label"),
        "preprocessed": lambda: F.col("source_domain"),
        "commoncrawl": lambda: F.lit(None).cast("string"),
    }
    source = sources.get(form, lambda: F.col("source"))()
    if path is not None:
        source = F.coalesce(source, source_of_path(path))
    return wide.select(
        F.coalesce("text", "content", "txt").alias("text"), source.alias("source_domain"), F.col("ppl").cast("double").alias("ppl"), F.col("quality_score").cast("double").alias("quality_score")
    )


def read_documents(spark: SparkSession, paths: str | Sequence[str], form: str) -> DataFrame:
    """Documents of one form in canonical columns. Lines that are no JSON give null texts and are kept for audits."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if form == "ppl":
        lines = spark.read.text(paths).select(F.split("value", "\t", 2).alias("p"), F.col("_metadata.file_path").alias("path"))
        parsed = lines.select(F.from_json(F.get("p", F.lit(1)), FORMATS["ppl"]).alias("j"), F.col("p")[0].alias("first"), "path")
        return canonical(parsed.select("j.txt", F.coalesce("j.source", "first").alias("source"), "j.ppl"), "ppl")
    raw = spark.read.schema(FORMATS[form]).json(paths)
    return canonical(raw.select("*", F.col("_metadata.file_path").alias("path")), form, F.col("path"))


def read_union(frames: Sequence[DataFrame]) -> DataFrame:
    """Several inputs below each other by name, columns missing in some as nulls."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, line_no, value``: the lines of text files with their 1-based number in the file.

    Splits of a file are numbered on their own; the number of lines in the splits before
    (one row a split) is added by a join. No file is read by a single task.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    sizes = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(starts, ["path", "block"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "value")


def line_range(lines: DataFrame, first: int, last: int) -> DataFrame:
    """Of numbered lines those from number ``first`` to ``last``, both included, of each file."""
    return lines.where(F.col("line_no").between(first, last))


def with_document_ids(lines: DataFrame) -> DataFrame:
    """Adds ``document_index`` as ``<source>_<line>`` to numbered lines."""
    return lines.withColumn("document_index", F.concat_ws("_", source_of_path(F.col("path")), F.col("line_no").cast("string")))


def _lines(stream, join_paragraphs: bool, joiner: str) -> Iterator[tuple]:
    """``text, meta`` of each JSON line of a compressed stream, which is read as it goes."""
    import zstandard

    reader = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    for line in io.TextIOWrapper(reader, encoding="utf-8"):
        if not line.strip():
            continue
        x = json.loads(line)
        text, meta = (x, None) if isinstance(x, str) else (x.get("text"), x.get("meta"))
        if isinstance(text, list) and join_paragraphs:
            text = joiner.join(text)
        yield text if isinstance(text, str) or text is None else json.dumps(text, ensure_ascii=False), None if meta is None else json.dumps(meta, ensure_ascii=False)


def _batches(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pd.DataFrame]:
    while part := list(islice(rows, size)):
        yield pd.DataFrame(part, columns=["text", "meta"])


def read_archive(spark: SparkSession, paths: str | Sequence[str], join_paragraphs: bool = True, joiner: str = "\n\n") -> DataFrame:
    """``text, meta`` of zstd-compressed JSON lines: bare strings, or objects with ``text`` (string or paragraphs) and ``meta``.

    A compressed file can't be split; archives come as many files, one task each. Files on a
    mounted folder are streamed from their path, so their size does not matter; elsewhere
    a file is read whole, up to 2 GB.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                with open(unquote(urlsplit(path).path), "rb") as f:
                    yield from _batches(_lines(f, join_paragraphs, joiner))

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                yield from _batches(_lines(io.BytesIO(content), join_paragraphs, joiner))

    files = spark.read.format("binaryFile").load(paths)
    mounted = all(urlsplit(p).scheme in ("", "file") for p in ([paths] if isinstance(paths, str) else paths)) and spark.conf.get("spark.hadoop.fs.defaultFS", "file:///").startswith("file:")
    if mounted:
        # Only paths and sizes are read here; a task a file.
        named = files.select("path", "length").where("length > 0").select("path")
        return named.repartition("path").mapInPandas(run, "text string, meta string")
    return files.select("content").mapInPandas(whole, "text string, meta string")


def read_archive_frames(spark: SparkSession, path: str) -> DataFrame:
    """``text, meta`` of what ``write_archive`` wrote, before or without its export to plain files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for frame in pdf["frame"]:
                yield from _batches(_lines(io.BytesIO(frame), True, "\n\n"))

    return spark.read.parquet(path).select("frame").mapInPandas(run, "text string, meta string")


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """``bucket, ngram, key`` of the lines that ``write_buckets`` wrote; lines of one n-gram follow each other in one bucket."""
    lines = spark.read.schema("value string, bucket int").text(path)
    return lines.select("bucket", F.regexp_extract("value", r"^(?s)(.*) ([^ ]*)$", 1).alias("ngram"), F.regexp_extract("value", r"^(?s)(.*) ([^ ]*)$", 2).alias("key"))


def read_responses(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``index, request, status, answer`` of a rater's response lines; ``answer`` is null where the nesting breaks off."""
    raw = spark.read.schema(RESPONSE).json(paths)
    user = F.try_element_at(F.filter("request_json.messages", lambda m: m["role"] == "user"), F.lit(-1))["content"]
    return raw.select("index", user.alias("request"), "status", F.get("response.data.response.choices", F.lit(0))["message"]["content"].alias("answer"))


def read_split(spark: SparkSession, path: str, split: str, split_column: str = "split") -> DataFrame:
    """Rows of one split of a benchmark stored with a split column; the folder of other splits is not read if partitioned by it."""
    return spark.read.parquet(path).where(F.col(split_column) == split)


def read_with_labels(spark: SparkSession, documents: str, labels: str, schema: str) -> DataFrame:
    """JSON documents joined with a file of one label a line, by line number."""
    docs = numbered_lines(spark, documents).select("line_no", F.from_json("value", schema).alias("d"))
    marks = numbered_lines(spark, labels).select("line_no", F.trim("value").alias("label"))
    return docs.join(marks, "line_no").select("line_no", "d.*", "label")


def count_lines(spark: SparkSession, paths: str | Sequence[str]) -> int:
    return spark.read.text(paths).count()


def natural_order(path: Column) -> Column:
    """Sort key of a path whose file name holds numbers: they compare by value."""
    return F.transform(F.regexp_extract_all(F.regexp_extract(path, r"([^/]+)$", 1), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p))


__all__ = ["DOCUMENT", "canonical", "count_lines", "line_range", "natural_order", "numbered_lines", "read_archive", "read_archive_frames", "read_buckets", "read_documents", "read_responses", "read_split", "read_union", "read_with_labels", "source_of_path", "with_document_ids"]
