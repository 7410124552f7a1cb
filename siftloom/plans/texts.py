"""Cleaning, counting, chunking, packing and contamination over the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftloom.functions import text as fn
from siftloom.functions.labels import METRICS, canonical_domain, canonical_domain_sql, canonical_lang, canonical_lang_sql, canonical_source, canonical_source_sql, line_of_id, source_of_id, source_of_id_sql
from siftloom.operators import chunk, decontam, filters, score
from siftloom.sources import readers

from .registry import query, rounded, table

_WORDS = r"[x FOR x IN regexp_split_to_array(text, '\s+') IF x <> '']"


@query(f"""SELECT doc_id, {canonical_source_sql("source")} AS source, {source_of_id_sql("document_index")} AS id_source, CAST(regexp_extract(document_index, '_([0-9]+)$', 1) AS BIGINT) AS line_no,
    {canonical_lang_sql("lang")} AS lang, {canonical_domain_sql("domain_type")} AS domain_type FROM documents""")
def canonical_labels(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id", canonical_source(F.col("source")).alias("source"), source_of_id(F.col("document_index")).alias("id_source"), line_of_id(F.col("document_index")).alias("line_no"),
        canonical_lang(F.col("lang")).alias("lang"), canonical_domain(F.col("domain_type")).alias("domain_type"),
    )


@query("SELECT text, regexp_replace(source, 'RedPajama', '') AS source_domain, CAST(NULL AS DOUBLE) AS ppl, CAST(NULL AS DOUBLE) AS quality_score FROM documents")
def canonical_documents(spark, d):
    nested = table(spark, d, "documents").select("text", F.struct(F.col("source").alias("redpajama_set_name")).alias("meta"))
    return readers.canonical(nested, "slimpajama")


@query("SELECT doc_id AS id, lang AS language, n_chars FROM documents")
def rename_drop_project(spark, d):
    docs = filters.rename_columns(filters.drop_columns(table(spark, d, "documents"), ["text"]), ["doc_id", "lang"], ["id", "language"])
    return filters.keep_columns(docs, ["id", "language", "n_chars", "absent"])


@query(f"""SELECT document_index, loaded_at, [c FOR c IN [{", ".join(f"CASE WHEN NOT coalesce(regexp_matches({m}, '^0*[1-5]$'), FALSE) THEN '{m}' END" for m in METRICS)}] IF c IS NOT NULL] AS failed FROM annotated""")
def ratings_validity(spark, d):
    rows = table(spark, d, "annotated")
    return rows.select("document_index", "loaded_at", filters.failed_columns(METRICS).alias("failed"))


@query("SELECT document_index, loaded_at, accuracy FROM annotated WHERE accuracy = '5'")
def filter_fives(spark, d):
    return filters.equals_five(table(spark, d, "annotated").select("document_index", "loaded_at", "accuracy"), "accuracy")


@query("""SELECT source, count(*) AS n, count(DISTINCT i) AS n_distinct, max(i) AS greatest, max(i) - count(DISTINCT i) AS missing
    FROM (SELECT regexp_extract(document_index, '^(.*)_[^_]*$', 1) AS source, CAST(regexp_extract(document_index, '_([0-9]+)$', 1) AS BIGINT) AS i FROM annotated) GROUP BY 1""")
def id_audit(spark, d):
    return filters.audit_sources(table(spark, d, "annotated"), fn.right_split(F.col("document_index"))[0], line_of_id(F.col("document_index")))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '^["“”](?:…+|\.\.\.+)["“”]', ''), '!\[\]\([/]?[^)]+\)\n', '', 'g') AS text FROM documents""")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.clean_text(F.col("text")).alias("text"))


@query(rf"SELECT doc_id, coalesce(len(regexp_split_to_array(text, '\s+')), 0) AS words, coalesce(len({_WORDS}), 0) AS trimmed_words, strlen(text) AS bytes FROM documents")
def text_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", fn.word_count(t).alias("words"), fn.trimmed_word_count(t).alias("trimmed_words"), fn.byte_count(t).alias("bytes"))


@query(rf"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents)
    SELECT doc_id, CASE WHEN len(w) > 16 THEN array_to_string(w[1:8], ' ') || ' ... ' || array_to_string(w[len(w) - 7:], ' ') ELSE array_to_string(w, ' ') END AS text FROM t""")
def truncate_middle(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(fn.truncate_middle(fn.words(F.col("text")), 16), " ").alias("text"))


_CHUNKS = rf"""t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    k AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 8) / 56), 0) AS BIGINT))) AS position FROM t),
    chunks AS (SELECT doc_id, position, w[position * 56 + 1 : position * 56 + 64] AS tokens FROM k)"""


def _chunks(spark, d):
    return chunk.chunk(table(spark, d, "documents").select("doc_id", fn.words(F.col("text")).alias("tokens")), "tokens", 64, 8, 16)


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(position AS INTEGER) AS position, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest FROM chunks WHERE len(tokens) >= 16")
def chunks_overlap(spark, d):
    return _chunks(spark, d).select("doc_id", "position", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(f"""WITH {_CHUNKS}, long AS (SELECT doc_id, position, tokens, len(tokens) AS n FROM chunks WHERE len(tokens) >= 16),
    placed AS (SELECT *, sum(n) OVER (ORDER BY doc_id, position ROWS UNBOUNDED PRECEDING) - n AS start FROM long),
    words AS (SELECT doc_id, position, start + i - 1 AS pos, tokens[i] AS w FROM placed, range(1, 65) r(i) WHERE i <= n),
    packed AS (SELECT CAST(pos // 256 AS BIGINT) AS row_no, count(*) AS n, md5(string_agg(w, ' ' ORDER BY pos)) AS digest, arg_max(doc_id, pos) AS doc_id FROM words GROUP BY 1)
    SELECT row_no, doc_id, n, digest FROM packed WHERE n = 256""")
def pack_fixed(spark, d):
    packed = chunk.pack_fixed(_chunks(spark, d), ["doc_id", "position"], "doc_id", "tokens", 256)
    return packed.select("row_no", "doc_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(rf"""WITH t AS (SELECT doc_id, coalesce(len({_WORDS}), 0) AS n FROM documents), f AS (SELECT doc_id, n, least(n, 128) AS first FROM t WHERE n > 0),
    w AS (SELECT doc_id, -1 AS a, first - 1 AS b, 0 AS c, first AS e FROM f
          UNION ALL SELECT doc_id, least(first + k * 97 + 97, n) - 129, least(first + k * 97 + 97, n) - 1, first + k * 97, least(first + k * 97 + 97, n)
          FROM f, range(0, 2000) r(k) WHERE first + k * 97 < n)
    SELECT doc_id, CAST(a AS INTEGER) AS input_start, CAST(b AS INTEGER) AS input_end, CAST(c AS INTEGER) AS target_start, CAST(e AS INTEGER) AS target_end FROM w""")
def rolling_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", fn.trimmed_word_count(F.col("text")).alias("n"))
    return docs.select("doc_id", F.explode(chunk.rolling_windows(F.col("n"), 128, 32)).alias("w")).select("doc_id", "w.*")


@query(r"""WITH RECURSIVE cut AS (
        SELECT doc_id, -1 AS piece, CAST(NULL AS VARCHAR) AS text, text AS rest FROM documents WHERE text <> ''
        UNION ALL
        SELECT doc_id, piece + 1, CASE WHEN pos = 0 THEN rest ELSE substr(rest, 1, 199 + pos) END, CASE WHEN pos > 0 THEN substr(rest, 201 + pos) END
        FROM (SELECT *, instr(substr(rest, 201), chr(10)) AS pos FROM cut WHERE rest <> ''))
    SELECT doc_id, CAST(piece AS INTEGER) AS piece, text FROM cut WHERE piece >= 0""")
def presplit_texts(spark, d):
    return chunk.presplit(table(spark, d, "documents").select("doc_id", "text"), "text", "\n", 200)


_FORM = r"""translate(regexp_replace(text, '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""


def _grams(source: str, key: str, n: int) -> str:
    return rf"""(SELECT DISTINCT {key}, array_to_string(w[i : i + {n - 1}], ' ') AS ngram
        FROM (SELECT {key}, [x FOR x IN regexp_split_to_array({_FORM}, '\s+') IF x <> ''] AS w FROM {source}) t, LATERAL (SELECT unnest(range(1, len(w) - {n - 2})) AS i))"""


@query(f"SELECT ngram, count(*) AS n_docs FROM {_grams('documents', 'doc_id', 5)} GROUP BY 1 HAVING count(*) > 10")
def ngram_doc_frequency(spark, d):
    return decontam.frequent_ngrams(table(spark, d, "documents"), "doc_id", "text", 5, 10)


@query(f"""SELECT item_id, count(DISTINCT ngram) AS n_grams, count(DISTINCT doc_id) AS n_docs
    FROM {_grams("(SELECT item_id, query AS text FROM eval_items)", "item_id", 8)} h JOIN {_grams("documents", "doc_id", 8)} t USING (ngram) GROUP BY 1""")
def ngram_overlap(spark, d):
    return decontam.overlap(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "query", 8)


# White space beside the ASCII one.
_BLANK = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_NORMAL = _FORM.replace("text,", "t,", 1)


@query(f"""WITH parts AS (SELECT doc_id, length(text) AS size, unnest(regexp_extract_all(text, '[{_BLANK}]+|[^{_BLANK}]+')) AS t, generate_subscripts(regexp_extract_all(text, '[{_BLANK}]+|[^{_BLANK}]+'), 1) AS i FROM documents),
    placed AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop FROM parts),
    words AS (SELECT doc_id, size, stop - length(t) AS begin, stop, {_NORMAL} AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM placed WHERE regexp_matches(t, '[^{_BLANK}]')),
    runs AS (SELECT doc_id, size, begin, lead(stop, 7) OVER o AS stop, array_to_string(list(w) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), ' ') AS ngram FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY n)),
    dirt AS (SELECT DISTINCT ngram FROM {_grams("(SELECT item_id, query AS text FROM eval_items)", "item_id", 8)}),
    hits AS (SELECT doc_id, size, greatest(begin - 200, 0) AS low, least(stop - 1 + 200, size) AS high, begin, count(*) OVER (PARTITION BY doc_id) AS n FROM runs WHERE stop IS NOT NULL AND ngram IN (SELECT ngram FROM dirt)),
    gaps AS (SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY begin), 0) AS a, low AS b FROM hits WHERE n <= 10
             UNION ALL SELECT doc_id, max(high) + 1, max(size) FROM hits WHERE n <= 10 GROUP BY doc_id HAVING max(size) - max(high) > 200),
    kept AS (SELECT doc_id, a, b FROM gaps WHERE b - a > 200 OR (doc_id, b) IN (SELECT doc_id, max(size) FROM hits GROUP BY 1)
             UNION ALL SELECT doc_id, 0, length(text) FROM documents WHERE length(text) >= 200 AND doc_id NOT IN (SELECT doc_id FROM hits))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk, substr(text, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)) AS text FROM kept JOIN documents USING (doc_id)""")
def decontaminated_chunks(spark, d):
    return decontam.decontaminate(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "query", 8)


def _split_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{_BLANK}]+')"


@query(f"""WITH c AS (SELECT w, count(*) AS n FROM (SELECT unnest({_split_sql("query")}) AS w FROM eval_items) GROUP BY 1), t AS (SELECT sum(n) + count(*) + 1 AS total FROM c),
    d AS (SELECT doc_id, unnest({_split_sql("text")}) AS w FROM documents),
    l AS (SELECT doc_id, count(*) AS n, sum(ln((coalesce(c.n, 0) + 1) / total)) AS ll FROM d LEFT JOIN c USING (w), t GROUP BY 1)
    SELECT doc_id, CAST(coalesce(l.n, 0) AS INTEGER) AS n, round(exp(-coalesce(ll, 0.0) / greatest(coalesce(l.n, 0), 1)), 6) AS ppl FROM documents LEFT JOIN l USING (doc_id)""")
def perplexity_scores(spark, d):
    """Unigram perplexity of whole texts by a model fitted on the fixed test items."""
    items = [r.query for r in table(spark, d, "eval_items").select("query").collect()]
    logs = score.token_logprobs(table(spark, d, "documents"), "doc_id", "text", lambda: score.UnigramModel.fit(items), "unigram", most=None)
    return logs.select("doc_id", F.size("logprobs").alias("n"), F.round(score.perplexity(F.col("logprobs")), 6).alias("ppl"))


@query(rf"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^["“”](?:…+|\.\.\.+)["“”]', ''), '!\[\]\([/]?[^)]+\)\n', '', 'g') AS p FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, length(p) AS size, {_split_sql("p")} AS w, length(regexp_replace(p, '[^\p{{L}}]', '', 'g')) AS letters FROM c),
    b AS (SELECT doc_id, size, len(w) AS n, CAST(1 + round_even(2 * (len(list_distinct(w)) / greatest(1, len(w))) + 2 * (letters / greatest(1, size)), 0) AS BIGINT) AS base FROM s)
    SELECT doc_id, chr(CAST(65 + size % 15 AS INTEGER)) AS application_domain, {", ".join(f"CAST(least(5, greatest(1, base + (n * {i + 3}) % 3 - 1)) AS VARCHAR) AS {m}" for i, m in enumerate(METRICS))} FROM b""")
def annotated_by_scorer(spark, d):
    """Ratings by the stand-in scorer through the same path a model takes."""
    from siftloom.operators.parse import parse_model_output

    docs = table(spark, d, "documents").select("doc_id", "text")
    return parse_model_output(score.annotate(docs, fn.clean_text(F.col("text")), score.HeuristicScorer, "heuristic"), "output").drop("text", "output")


@query("""WITH r AS (SELECT request_id, sha256(request_index) AS key FROM gpt_responses), c AS (SELECT DISTINCT sha256(document_index) AS key FROM documents)
    SELECT request_id, c.key IS NOT NULL AS hit FROM r LEFT JOIN c ON r.key = c.key""")
def cache_hit_miss(spark, d):
    requests = table(spark, d, "gpt_responses").select("request_id", F.sha2("request_index", 256).alias("key"))
    cache = table(spark, d, "documents").select(F.sha2("document_index", 256).alias("key"), F.lit("known").alias("output"))
    answered, _ = score.with_cache(requests, cache, lambda missing: missing.select("key", F.lit("fresh").alias("output")))
    return answered.select("request_id", (F.col("output") == "known").alias("hit"))


@query(r"""SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(text, ' n''t', 'n''t'), ' )', ')'), '( ', '('), '" ', '"'), ' "', '"'), ' ([''.,])', '\1', 'g') AS text FROM documents""")
def detokenize_general(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.general_detokenize(F.col("text")).alias("text"))


@query(r"SELECT doc_id, regexp_extract_all(text, '\S+')[1:3] AS head FROM documents WHERE length(text) <= 100")
def short_texts(spark, d):
    docs = table(spark, d, "documents")
    kept = filters.within_tokens(docs, "text", [F.length], 100)
    return rounded(kept.select("doc_id", F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 3).alias("head")))
