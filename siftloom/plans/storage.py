"""Sources and sinks: what is written in the shared folder and read back, from whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftloom.functions.labels import METRICS, canonical_source, canonical_source_sql
from siftloom.session import shared_folder
from siftloom.sources import readers, writers

from .registry import query, table


def _place(spark) -> str:
    """A new path in the shared folder of the application, removed when it ends."""
    top = f"{shared_folder(spark)}/siftloom-{spark.sparkContext.applicationId}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return f"{top}/{uuid.uuid4().hex}"


_DOCS = "SELECT text, source AS source_domain, CAST(NULL AS DOUBLE) AS ppl, CAST(NULL AS DOUBLE) AS quality_score FROM documents WHERE source IS NOT NULL AND text IS NOT NULL"


@query(_DOCS)
def jsonl_scan(spark, d):
    """Documents as JSON lines and back through the ``qwen`` form."""
    at = _place(spark)
    writers.write_jsonl(table(spark, d, "documents").where("source is not null and text is not null").select("text", "source"), at, 4)
    return readers.read_documents(spark, at, "qwen")


@query("SELECT regexp_replace(source, '^RedPajama', '') AS source_domain, md5(text) AS digest FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def jsonl_nested_scan(spark, d):
    """The same through the form whose source is nested."""
    at = _place(spark)
    writers.write_jsonl(table(spark, d, "documents").where("source is not null and text is not null").select("text", F.struct(F.concat(F.when(~F.col("source").startswith("RedPajama"), "RedPajama").otherwise(""), "source").alias("redpajama_set_name")).alias("meta")), at, 2)
    return readers.read_documents(spark, at, "slimpajama").select("source_domain", F.md5("text").alias("digest"))


@query("SELECT md5(text) AS digest, coalesce(source, 'none') AS source_domain, n_chars / 8.0 AS ppl FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\\n\\r\\x{85}\\x{2028}\\x{2029}\\x0b\\x0c\\t]')")
def ppl_lines_scan(spark, d):
    """Tab-separated perplexity lines; texts of one line."""
    at = _place(spark)
    rows = table(spark, d, "documents").where(~F.col("text").rlike("[\\n\\r\\x{85}\\x{2028}\\x{2029}\\x0b\\x0c\\t]"))
    line = F.concat_ws("\t", F.coalesce("source", F.lit("none")), F.to_json(F.struct(F.col("text").alias("txt"), (F.col("n_chars") / 8).alias("ppl"))))
    rows.select(line.alias("value")).write.text(at)
    return readers.read_documents(spark, at, "ppl").select(F.md5("text").alias("digest"), "source_domain", "ppl")


@query("SELECT md5(text) AS digest, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT query FROM eval_items) WHERE text IS NOT NULL GROUP BY 1")
def union_scan(spark, d):
    """Two inputs of different columns below each other."""
    both = readers.read_union([table(spark, d, "documents").select("text", "lang", "source"), table(spark, d, "eval_items").select(F.col("query").alias("text"), "task_name")])
    return both.where("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query("SELECT source, name, row_number() OVER (PARTITION BY source ORDER BY name) AS line_no, source || '_' || row_number() OVER (PARTITION BY source ORDER BY name) AS document_index FROM (SELECT task_name AS source, lpad(CAST(item_id AS VARCHAR), 9, '0') AS name FROM eval_items)")
def numbered_line_scan(spark, d):
    """One file a task, its lines numbered over all splits, with ids built of file and line."""
    at = _place(spark)
    items = table(spark, d, "eval_items").select("task_name", F.lpad(F.col("item_id").cast("string"), 9, "0").alias("value"))
    for (task,) in items.select("task_name").distinct().orderBy("task_name").collect():  # a file a benchmark, tens at most
        items.where(F.col("task_name") == task).orderBy("value").coalesce(1).select("value").write.text(f"{at}/{task}.lst")
    names = [r.task_name for r in items.select("task_name").distinct().collect()]
    lines = readers.numbered_lines(spark, [f"{at}/{n}.lst" for n in names]).withColumn("path", F.regexp_replace("path", r"/[^/]*$", ""))
    return readers.with_document_ids(lines).select(readers.source_of_path(F.col("path")).alias("source"), F.col("value").alias("name"), "line_no", "document_index")


@query("SELECT item_id, task_name FROM (SELECT *, row_number() OVER (ORDER BY item_id) AS n FROM eval_items) WHERE n BETWEEN 101 AND 300")
def line_range_scan(spark, d):
    """Lines 101 to 300 of a file: a range of positions is the operator's feature."""
    at = _place(spark)
    table(spark, d, "eval_items").orderBy("item_id").coalesce(1).select(F.to_json(F.struct("item_id", "task_name")).alias("value")).write.text(at)
    lines = readers.line_range(readers.numbered_lines(spark, at), 101, 300)
    return lines.select(F.from_json("value", "item_id long, task_name string").alias("x")).select("x.*")


@query("SELECT item_id, query, CASE WHEN gold = 0 THEN 'right' ELSE 'wrong' END AS label FROM eval_items")
def labelled_scan(spark, d):
    """JSON documents with a second file of one label a line."""
    at, items = _place(spark), table(spark, d, "eval_items").orderBy("item_id").coalesce(1)
    items.select(F.to_json(F.struct("item_id", "query")).alias("value")).write.text(f"{at}/docs")
    items.select(F.when(F.col("gold") == 0, "right").otherwise("wrong").alias("value")).write.text(f"{at}/labels")
    return readers.read_with_labels(spark, f"{at}/docs", f"{at}/labels", "item_id long, query string").select("item_id", "query", "label")


@query("SELECT md5(text) AS digest, doc_id FROM documents WHERE text IS NOT NULL")
def archive_round_trip(spark, d):
    """Documents as zstd archives of JSON lines and back."""
    at = _place(spark)
    docs = table(spark, d, "documents").where("text is not null").select("text", F.to_json(F.struct("doc_id")).alias("meta"))
    writers.write_archive(docs, f"{at}/frames", meta="meta")
    return readers.read_archive_frames(spark, f"{at}/frames").select(F.md5("text").alias("digest"), F.get_json_object("meta", "$.doc_id").cast("long").alias("doc_id"))


@query("SELECT document_index, loaded_at, CAST(length % 7 AS INTEGER) AS shard FROM annotated WHERE length IS NOT NULL")
def shard_folders(spark, d):
    """A folder a shard, written and read as a partitioned table; finished ones are skipped the second time."""
    at = _place(spark)
    rows = table(spark, d, "annotated").where("length is not null").select("document_index", "loaded_at", (F.col("length") % 7).cast("int").alias("shard"))
    if not writers.write_shards(rows, at) or writers.write_shards(rows, at):
        raise RuntimeError("a finished output is left as it is")
    return spark.read.schema(rows.schema).parquet(at)


@query(f"""SELECT criterion, {canonical_source_sql("source_domain")} AS source, value, count(*) AS n FROM annotated UNPIVOT (value FOR criterion IN (accuracy, coherence))
    WHERE regexp_matches(value, '^[1-5]$') AND {canonical_source_sql("source_domain")} IS NOT NULL GROUP BY ALL""")
def cell_folders(spark, d):
    """Each (criterion, source, value) cell as a folder, counted back from the folders."""
    at = _place(spark)
    marks = [F.when(F.col(m).rlike("^[1-5]$"), F.col(m)).alias(m) for m in ("accuracy", "coherence")]
    rows = table(spark, d, "annotated").select("document_index", canonical_source(F.col("source_domain")).alias("source"), *marks).where("source is not null")
    writers.write_cells(rows, at, "source", ["accuracy", "coherence"])
    read = spark.read.schema("document_index string, criterion string, source string, value string").parquet(at)
    return read.groupBy("criterion", "source", "value").agg(F.count("*").alias("n"))


@query(f"""SELECT CASE WHEN {" AND ".join(f"coalesce(regexp_matches({m}, '^0*[1-5]$'), FALSE)" for m in METRICS)} THEN 'success' ELSE 'failed' END AS outcome, document_index, loaded_at FROM annotated""")
def valid_and_failed(spark, d):
    """Rows that pass and rows that fail in one pass, read back with their outcome."""
    from siftloom.operators.filters import all_valid

    at, rows = _place(spark), table(spark, d, "annotated")
    writers.split_valid(rows.select("document_index", "loaded_at", all_valid(METRICS).alias("ok")), at, F.col("ok"))
    return spark.read.schema("document_index string, loaded_at timestamp, outcome string").parquet(at)


@query("SELECT request_id, request_json.messages[-1].content AS request, status, gpt_response AS answer FROM gpt_responses WHERE gpt_response IS NOT NULL")
def response_scan(spark, d):
    """Response lines in the nested layout of the rater and back."""
    at = _place(spark)
    message = F.array(F.struct(F.struct(F.col("gpt_response").alias("content")).alias("message")))
    nested = F.struct(F.struct(F.struct(message.alias("choices")).alias("response")).alias("data"))
    rows = table(spark, d, "gpt_responses").where("gpt_response is not null")
    writers.write_jsonl(rows.select(F.col("request_id").cast("string").alias("index"), "request_json", "status", nested.alias("response")), at)
    return readers.read_responses(spark, at).select(F.col("index").cast("long").alias("request_id"), "request", "status", "answer")


@query("SELECT item_id, task_name, gold FROM eval_items WHERE lang = 'zh'")
def benchmark_split(spark, d):
    """One split of a benchmark stored by split; the other splits' folders are not read."""
    at = _place(spark)
    table(spark, d, "eval_items").select("item_id", "task_name", "gold", "lang").write.partitionBy("lang").parquet(at)
    return readers.read_split(spark, at, "zh", "lang").select("item_id", "task_name", "gold")


@query("SELECT doc_id, row_number() OVER (ORDER BY length(regexp_replace(name, '[0-9]', '', 'g')) * 0, CAST(regexp_extract(name, '([0-9]+)', 1) AS BIGINT), doc_id) AS place FROM (SELECT doc_id, 'part' || n_chars AS name FROM documents)")
def natural_file_order(spark, d):
    """Names that hold numbers in order of their value."""
    from siftloom.operators.prefix import running_total

    named = table(spark, d, "documents").select("doc_id", F.array_join(readers.natural_order(F.concat(F.lit("x/part"), F.col("n_chars").cast("string"))), "|").alias("name"))
    return running_total(named, [], [F.col("name"), F.col("doc_id")], {"place": F.lit(1)}).select("doc_id", "place")


@query("SELECT ngram, count(*) AS n FROM (SELECT task_name, unnest(regexp_split_to_array(query, '\\s+')) AS ngram FROM eval_items) WHERE ngram <> '' GROUP BY 1")
def bucket_text_counts(spark, d):
    """N-gram lines in hash buckets sorted by n-gram, read back bucket by bucket and counted without another shuffle of lines."""
    at = _place(spark)
    lines = table(spark, d, "eval_items").select("item_id", F.explode(F.filter(F.split("query", r"\s+"), lambda w: w != "")).alias("ngram"))
    writers.write_buckets(lines, at, "ngram", "item_id", 8)
    return readers.read_buckets(spark, at).groupBy("ngram").agg(F.count("*").alias("n"))


@query("SELECT doc_id, row_no, tokens FROM (SELECT doc_id, 0 AS row_no, [length(x) FOR x IN regexp_extract_all(text, '[0-9]+')[1:5]] AS tokens FROM documents WHERE text IS NOT NULL) WHERE len(tokens) > 0")
def tokenized_round_trip(spark, d):
    """Token rows as Parquet with a codec and level, and back."""
    at = _place(spark)
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.lit(0).alias("row_no"), F.transform(F.slice(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), 1, 5), F.length).alias("tokens")).where(F.size("tokens") > 0)
    writers.write_parquet(rows, at, 3, level=9)
    return spark.read.parquet(at)

