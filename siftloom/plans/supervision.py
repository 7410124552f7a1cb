"""Requests, responses and rating reports: from a rater's answers to training rows and agreement figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftloom.functions.labels import METRICS, canonical_domain, canonical_domain_sql
from siftloom.operators import chunk, parse, rater

from .registry import RATED, STATS, query, rated, rounded, stats, table

_REQUEST = "list_filter(request_json.messages, lambda m: m.role = 'user')[-1].content"


def _answers(spark, d, lang: str):
    r = table(spark, d, "gpt_responses")
    request = F.try_element_at(F.filter("request_json.messages", lambda m: m["role"] == "user"), F.lit(-1))["content"]
    chinese = F.substring(request, 1, 1) == "请"
    return r.select("request_id", "request_index", "status", F.col("gpt_response").alias("answer"), request.alias("request")).where(chinese if lang == "zh" else ~chinese)


_ZH = f"""answers AS (SELECT request_id, request_index, status, gpt_response AS answer, {_REQUEST} AS request FROM gpt_responses WHERE left({_REQUEST}, 1) = '请'),
    parts AS (SELECT *, [CAST(x AS DOUBLE) FOR x IN regexp_extract_all(coalesce(answer, ''), '\\[[1-9][0-4]?\\][^：]+：(\\d+(?:\\.\\d+)?)/5', 1)] AS s,
        list_distinct(regexp_extract_all(coalesce(answer, ''), '领域类型.*?[\\[\\]]?([A-Z])[\\]\\[]?', 1)) AS c FROM answers),
    judged AS (SELECT *, CASE WHEN coalesce(status <> 'success', TRUE) THEN 'api_failure' WHEN regexp_matches(coalesce(answer, ''), '：N/A') THEN 'na_present'
        WHEN len(s) = 0 THEN 'no_scores' WHEN len(s) < 14 THEN 'too_few' WHEN len(s) > 14 AND len(s) <> 28 THEN 'too_many'
        WHEN len(s) = 28 AND s[1:14] <> s[15:28] THEN 'conflicting' WHEN len(c) = 0 THEN 'no_category' WHEN len(c) > 1 THEN 'several_categories' ELSE 'ok' END AS outcome FROM parts)"""


@query(f"WITH {_ZH} SELECT request_id, outcome, CASE WHEN outcome = 'ok' THEN c[1] END AS category FROM judged")
def response_outcome_zh(spark, d):
    return parse.accept(_answers(spark, d, "zh"), "zh").select("request_id", "outcome", "category")


@query(f"""WITH {_ZH} SELECT request_id, {", ".join(f"CAST(CASE WHEN s[{i + 1}] < 3 THEN floor(s[{i + 1}]) ELSE ceil(s[{i + 1}]) END AS INTEGER) AS {m}" for i, m in enumerate(METRICS))} FROM judged WHERE outcome = 'ok'""")
def response_scores_zh(spark, d):
    return parse.typed_ratings(parse.accept(_answers(spark, d, "zh"), "zh")).select("request_id", *METRICS)


# The patterns of ``parse`` with what they look at behind and ahead written out, and ``.`` as it is read there.
_ANY = r"[^\n\r\x{85}\x{2028}\x{2029}]*"
_EN = rf"""answers AS (SELECT request_id, status, coalesce(gpt_response, '') AS a FROM gpt_responses WHERE left({_REQUEST}, 1) <> '请'),
    parts AS (SELECT *, [CAST(x AS DOUBLE) FOR x IN regexp_extract_all(a, '(?:\[[1-9][0-4]?\]|\b[1-9][0-4]?\.|\b[1-9][0-4]?\)){_ANY}(?:\*+|\s+|\(+)(\d+(\.\d+)?)/5', 1)] AS s,
        list_distinct(regexp_extract_all(a, '\[\s*([A-Z])\s*\]', 1) || [x[2] FOR x IN regexp_extract_all(a, '\s[A-Z]\]+') IF length(x) = 3]
            || regexp_extract_all(a, '\bDomain Type:\**\s*\**([A-Z])\s*[()*-]', 1)) AS c FROM answers),
    judged AS (SELECT *, CASE WHEN coalesce(status <> 'success', TRUE) THEN 'api_failure' WHEN regexp_matches(a, '(?:\*\s|:\s)N/A') THEN 'na_present'
        WHEN len(s) = 0 THEN 'no_scores' WHEN len(s) < 14 THEN 'too_few' WHEN len(s) > 14 AND len(s) <> 28 THEN 'too_many'
        WHEN len(s) = 28 AND s[1:14] <> s[15:28] THEN 'conflicting' WHEN len(c) = 0 THEN 'no_category' WHEN len(c) > 1 THEN 'several_categories' ELSE 'ok' END AS outcome FROM parts)"""


@query(f"WITH {_EN} SELECT request_id, outcome, CASE WHEN outcome = 'ok' THEN c[1] END AS category FROM judged")
def response_outcome_en(spark, d):
    return parse.accept(_answers(spark, d, "en"), "en").select("request_id", "outcome", "category")


@query(f"""SELECT request_id, CASE WHEN regexp_matches(request, '(?s)\\nText: (.*?)(\\n)+(?:Domain Types|Overall Score)') THEN regexp_extract(request, '(?s)\\nText: (.*?)(\\n)+(?:Domain Types|Overall Score)', 1) END AS text
    FROM (SELECT request_id, {_REQUEST} AS request FROM gpt_responses) WHERE left(request, 1) <> '请'""")
def request_original_text(spark, d):
    return _answers(spark, d, "en").select("request_id", parse.original_text(F.col("request"), "en").alias("text"))


@query("""SELECT r.request_id, d.n_chars FROM gpt_responses r
    JOIN documents d ON regexp_extract(r.request_index, '^(.*)_([^_]*)$', 1) = regexp_extract(d.document_index, '^(.*)_([^_]*)$', 1)
                    AND regexp_extract(r.request_index, '^(.*)_([^_]*)$', 2) = regexp_extract(d.document_index, '^(.*)_([^_]*)$', 2)""")
def detail_text_join(spark, d):
    joined = parse.detail_text(table(spark, d, "gpt_responses").select("request_id", "request_index"), "request_index", table(spark, d, "documents"), "document_index", "text")
    return joined.select("request_id", F.length("full_text").cast("long").alias("n_chars"))


@query("SELECT document_index, loaded_at FROM annotated WHERE document_index NOT IN (SELECT document_index FROM documents WHERE document_index IS NOT NULL)")
def exclude_existing(spark, d):
    rows = table(spark, d, "annotated").select("document_index", "loaded_at")
    return parse.exclude_existing(rows, "document_index", table(spark, d, "documents"), "document_index")


_PROMPT = "Please name the domain type of the text:\nText: {text}\nDomain:_"


@query(r"""SELECT document_index AS index, md5('Please name the domain type of the text:' || chr(10) || 'Text: ' ||
        regexp_replace(regexp_replace(text, '^["“”](?:…+|\.\.\.+)["“”]', ''), '!\[\]\([/]?[^)]+\)\n', '', 'g') || chr(10) || 'Domain:_') AS digest, 1 AS n_messages FROM documents""")
def built_requests(spark, d):
    requests = parse.build_requests(table(spark, d, "documents"), "document_index", "text", _PROMPT, "rater")
    return requests.select("index", F.md5(F.col("request_json.messages")[0]["content"]).alias("digest"), F.size("request_json.messages").alias("n_messages"))


@query(f"""WITH {RATED} SELECT source, role, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM (
        SELECT regexp_extract(document_index, '^(.*)_([^_]*)$', 1) AS source, 'user' AS role, 'Rate ' || document_index AS content, overall_score FROM rated
        UNION ALL SELECT regexp_extract(document_index, '^(.*)_([^_]*)$', 1), 'assistant', application_domain || chr(10) || overall_score, overall_score FROM rated)
    WHERE overall_score IS NOT NULL GROUP BY 1, 2""")
def training_samples(spark, d):
    rows = rated(spark, d).where("overall_score is not null")
    built = parse.build_sample(rows, "document_index", F.concat(F.lit("Rate "), "document_index"), F.concat_ws("\n", "application_domain", F.col("overall_score").cast("string")))
    return built.select("source", F.explode("messages").alias("m")).groupBy("source", "m.role").agg(F.count("*").alias("n"), F.sum(F.length("m.content")).alias("chars"))


def _masked_chats(spark, d, most: int | None):
    rows = table(spark, d, "gpt_responses").select("request_id", F.try_element_at(F.filter("request_json.messages", lambda m: m["role"] == "user"), F.lit(-1)).alias("u"), F.coalesce("gpt_response", F.lit("")).alias("a"))
    chat = F.array(F.struct(F.lit("user").alias("role"), F.col("u.content").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("a").alias("content")))
    encode = lambda c: F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), F.length)
    masked = rows.select("request_id", chunk.chat_loss_mask(chat, encode, most).alias("m"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return masked.select(
        "request_id", F.size("m.input_ids").alias("n"), total(F.col("m.attention_mask")).cast("int").alias("attended"), F.size(F.filter("m.labels", lambda x: x != -100)).alias("learned"), total(F.col("m.input_ids")).alias("id_sum"),
    )


@query(f"""WITH t AS (SELECT request_id, [length(w) FOR w IN regexp_split_to_array({_REQUEST}, '\\s+') IF w <> ''] AS p, [length(w) FOR w IN regexp_split_to_array(coalesce(gpt_response, ''), '\\s+') IF w <> ''] AS r FROM gpt_responses)
    SELECT request_id, len(p) + len(r) AS n, len(p) + len(r) AS attended, len(r) AS learned, CAST(coalesce(list_sum(p || r), 0) AS BIGINT) AS id_sum FROM t""")
def chat_loss_mask(spark, d):
    """Word lengths stand in for token ids; whole conversations, so that every word of every answer is learned."""
    return _masked_chats(spark, d, None)


def _truth(spark, d):
    s = stats(spark, d)
    whole = [F.when(F.col(m) < 3, F.floor(m)).otherwise(F.ceil(m)).cast("int").alias(m) for m in METRICS]
    return s.groupBy("sample_index").agg(F.max("source").alias("source"), F.max("category").alias("category"), *[F.max(m).alias(m) for m in METRICS]).select("sample_index", "source", "category", *whole)


_TRUTH = f"""{STATS}, truth AS (SELECT sample_index, max(source) AS source, max(category) AS category, {", ".join(f"CAST(CASE WHEN max({m}) < 3 THEN floor(max({m})) ELSE ceil(max({m})) END AS INTEGER) AS {m}" for m in METRICS)} FROM stats GROUP BY 1)"""
_REPORT = """count(*) AS n, round(avg(CAST(t = p AS INTEGER)), 6) AS accuracy_5, round(avg(CAST((t < 3) = (p < 3) AS INTEGER)), 6) AS accuracy_2,
    round(count(*) FILTER (WHERE t < 3 AND p < 3) / nullif(count(*) FILTER (WHERE t < 3), 0), 6) AS negative_accuracy, round(count(*) FILTER (WHERE t >= 3 AND p >= 3) / nullif(count(*) FILTER (WHERE t >= 3), 0), 6) AS positive_accuracy,
    round(count(*) FILTER (WHERE t < 2 AND p >= 3) / nullif(count(*) FILTER (WHERE t < 3), 0), 6) AS miss_1, round(count(*) FILTER (WHERE t >= 2 AND t < 3 AND p > 3) / nullif(count(*) FILTER (WHERE t < 3), 0), 6) AS miss_2,
    round(count(*) FILTER (WHERE t >= 2 AND t < 3 AND p = 3) / nullif(count(*) FILTER (WHERE t < 3), 0), 6) AS miss_3, round(count(*) FILTER (WHERE t >= 4 AND p < 3) / nullif(count(*) FILTER (WHERE t >= 3), 0), 6) AS misjudge_1,
    round(count(*) FILTER (WHERE t >= 3 AND t < 4 AND p < 3) / nullif(count(*) FILTER (WHERE t >= 3), 0), 6) AS misjudge_2, CASE WHEN NOT isnan(corr(t, p)) THEN round(corr(t, p), 6) END AS pearson"""


def _pairs(spark, d):
    t = _truth(spark, d).select("sample_index", "source", "category", F.col("overall_score").alias("t"))
    return t.join(rated(spark, d).select(F.col("document_index").alias("sample_index"), F.col("overall_score").alias("p"), "application_domain"), "sample_index")


@query(f"""WITH {RATED}, {_TRUTH}, x AS (SELECT s.source, s.overall_score AS t, r.overall_score AS p FROM truth s JOIN rated r ON r.document_index = s.sample_index)
    SELECT source, {_REPORT} FROM x WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY 1""")
def rater_scores_by_source(spark, d):
    return rounded(rater.score_report(_pairs(spark, d), ["source"], "t", "p"))


@query(f"""WITH {RATED}, {_TRUTH}, a AS (SELECT sample_index, criterion, t FROM truth UNPIVOT (t FOR criterion IN ({", ".join(METRICS)}))), b AS (SELECT document_index, criterion, p FROM rated UNPIVOT (p FOR criterion IN ({", ".join(METRICS)}))),
    x AS (SELECT a.criterion, t, p FROM a JOIN b ON a.sample_index = b.document_index AND a.criterion = b.criterion),
    k AS (SELECT *, rank() OVER (PARTITION BY criterion ORDER BY t) + (count(*) OVER (PARTITION BY criterion, t) - 1) / 2 AS rt, rank() OVER (PARTITION BY criterion ORDER BY p) + (count(*) OVER (PARTITION BY criterion, p) - 1) / 2 AS rp FROM x)
    SELECT criterion, {_REPORT}, CASE WHEN NOT isnan(corr(rt, rp)) THEN round(corr(rt, rp), 6) END AS spearman FROM k GROUP BY 1""")
def rater_scores_by_criterion(spark, d):
    pairs = rater.rating_pairs(_truth(spark, d).withColumnRenamed("sample_index", "k"), rated(spark, d).withColumnRenamed("document_index", "k"), "k", METRICS)
    return rounded(rater.all_rating_report(pairs))


@query(f"""WITH {RATED}, {_TRUTH}, x AS (SELECT source, {canonical_domain_sql("category")} AS t, application_domain AS p FROM truth JOIN rated ON document_index = sample_index),
    labels AS (SELECT source, t AS label FROM x UNION SELECT source, p FROM x),
    c AS (SELECT l.source, label, count(*) FILTER (WHERE x.t = label) AS nt, count(*) FILTER (WHERE x.p = label) AS np, count(*) FILTER (WHERE x.t = label AND x.p = label) AS k
          FROM labels l JOIN x ON x.source IS NOT DISTINCT FROM l.source GROUP BY 1, 2)
    SELECT source, CAST(sum(nt) AS BIGINT) AS n, round(sum(k) / sum(nt), 6) AS accuracy, round(avg(2 * k / (nt + np)), 6) AS macro_f1, round(2 * sum(k) / (sum(nt) + sum(np)), 6) AS micro_f1,
           round(sum(nt * 2 * k / (nt + np)) / sum(nt), 6) AS weighted_f1, round(var_pop(CASE WHEN nt > 0 THEN round(k / nt, 3) END), 6) AS recall_variance FROM c WHERE source IS NOT NULL GROUP BY 1""")
def rater_domains_by_source(spark, d):
    pairs = _pairs(spark, d).where("source is not null").withColumn("category", canonical_domain(F.col("category")))
    return rounded(rater.class_report(pairs, ["source"], "category", "application_domain"))


@query(f"""WITH {RATED}, {_TRUTH} SELECT sample_index, s.overall_score AS t, r.overall_score AS p, CASE WHEN s.overall_score < 2 THEN 'miss' ELSE 'misjudge' END AS "case"
    FROM truth s JOIN rated r ON r.document_index = s.sample_index WHERE (s.overall_score < 2 AND r.overall_score >= 3) OR (s.overall_score >= 4 AND r.overall_score <= 2)""")
def rater_false_cases(spark, d):
    return rater.false_cases(_pairs(spark, d), "t", "p").select("sample_index", "t", "p", "case")


@query(f"""WITH {RATED}, {_TRUTH}, x AS (SELECT s.overall_score AS truth, r.overall_score AS predicted FROM truth s JOIN rated r ON r.document_index = s.sample_index)
    SELECT truth, predicted, count(*) AS n FROM x WHERE truth IS NOT NULL AND predicted IS NOT NULL GROUP BY 1, 2""")
def rater_confusion(spark, d):
    return rater.confusion(_pairs(spark, d), [], "t", "p")


