"""Response filters, metrics, errors and group results over the test items."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from siftloom.functions import text as fn
from siftloom.functions.numeric import draw_sql
from siftloom.operators import evaluate as ev
from siftloom.operators import rater

from .registry import query, rounded, table

# Option scores stand in for log likelihoods: arithmetic both engines share.
_SCORES = "[-(length(c) * (item_id % 5 + 1)) / 10.0 FOR c IN choices]"


def _items(spark, d):
    items = table(spark, d, "eval_items")
    return items.withColumn("scores", F.transform("choices", lambda c: -(F.length(c) * (F.col("item_id") % 5 + 1)) / 10.0))


_PER_ITEM = f"""items AS (SELECT *, {_SCORES} AS scores FROM eval_items), m AS (SELECT *,
    CAST(list_position(scores, list_max(scores)) - 1 = gold AS INTEGER) AS acc,
    CAST(list_position([-(item_id % 5 + 1) / 10.0 FOR c IN choices], -(item_id % 5 + 1) / 10.0) - 1 = gold AS INTEGER) AS acc_norm,
    1 + len([s FOR s IN scores IF s > scores[gold + 1]]) AS place,
    list_sum([exp(s - list_max(scores)) FOR s IN scores]) AS z FROM items)"""


@query(f"""WITH {_PER_ITEM}, p AS (SELECT *, list_sum([power(exp(s - list_max(scores)) / z - CASE WHEN i - 1 = gold THEN 1.0 ELSE 0.0 END, 2) FOR s, i IN scores]) AS brier FROM m)
    SELECT task_name, count(*) AS n, round(avg(acc), 6) AS acc, round(stddev_samp(acc) / sqrt(count(*)), 6) AS acc_stderr, round(avg(brier), 6) AS brier,
           round(avg(1 / place), 6) AS mrr, round(avg(CAST(place <= 1 AS INTEGER)), 6) AS recall_1, round(avg(CAST(place <= 2 AS INTEGER)), 6) AS recall_2 FROM p GROUP BY 1""")
def choice_metrics(spark, d):
    g = F.col("gold")
    m = _items(spark, d).select("task_name", ev.accuracy(F.col("scores"), g).alias("acc"), ev.brier(F.col("scores"), g).alias("brier"), ev.gold_rank(F.col("scores"), g).alias("place"))
    a = ev.AGGREGATIONS
    return rounded(m.groupBy("task_name").agg(
        F.count("*").alias("n"), a["mean"](F.col("acc")).alias("acc"), a["stderr"](F.col("acc")).alias("acc_stderr"), a["brier_score"](F.col("brier")).alias("brier"),
        F.avg(1 / F.col("place")).alias("mrr"), F.avg((F.col("place") <= 1).cast("double")).alias("recall_1"), F.avg((F.col("place") <= 2).cast("double")).alias("recall_2"),
    ))


@query(f"""WITH items AS (SELECT item_id, task_name, gold, choices, [-(length(c) + item_id % 3 * list_position(choices, c)) / 7.0 FOR c IN choices] AS scores FROM eval_items),
    n AS (SELECT *, [s / length(choices[i]) FOR s, i IN scores] AS per_char FROM items)
    SELECT task_name, round(avg(CAST(list_position(per_char, list_max(per_char)) - 1 = gold AS INTEGER)), 6) AS acc_norm,
           round(avg(CAST(list_position([s + i FOR s, i IN scores], list_max([s + i FOR s, i IN scores])) - 1 = gold AS INTEGER)), 6) AS acc_mutual_info FROM n GROUP BY 1""")
def choice_metrics_normalized(spark, d):
    items = table(spark, d, "eval_items")
    scores = F.transform("choices", lambda c: -(F.length(c) + F.col("item_id") % 3 * F.array_position("choices", c)) / 7.0)
    rows = items.withColumn("scores", scores).withColumn("alone", F.transform("choices", lambda c, i: (-(i + 1)).cast("double")))
    m = rows.select("task_name", ev.accuracy_norm(F.col("scores"), F.col("choices"), F.col("gold")).alias("a"), ev.accuracy_mutual(F.col("scores"), F.col("alone"), F.col("gold")).alias("b"))
    return rounded(m.groupBy("task_name").agg(F.avg("a").alias("acc_norm"), F.avg("b").alias("acc_mutual_info")))


@query(r"""SELECT item_id, coalesce(nullif(regexp_extract_all(query, '(\d+)', 1)[1], ''), '[invalid]') AS first_number, coalesce(regexp_extract_all(query, '(\d+)', 1)[-1], '[invalid]') AS last_number FROM eval_items""")
def filter_regex(spark, d):
    r = F.array("query")
    first, last = (ev.pipeline(r, [("regex", r"(\d+)", 1, k), ("take_first",)]) for k in (0, -1))
    return table(spark, d, "eval_items").select("item_id", F.element_at(first, 1).alias("first_number"), F.element_at(last, 1).alias("last_number"))


@query(r"""WITH w AS (SELECT item_id, [lower(x) FOR x IN regexp_split_to_array(query, '\s+') IF x <> ''] AS w FROM eval_items), u AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w)
    SELECT item_id, arg_min(x, -n * 100000 + i) AS winner FROM (SELECT item_id, x, count(*) AS n, min(i) AS i FROM u GROUP BY 1, 2) GROUP BY 1""")
def filter_majority(spark, d):
    votes = ev.pipeline(fn.words(F.col("query")), [("lowercase",), ("majority_vote",)])
    return table(spark, d, "eval_items").select("item_id", F.element_at(votes, 1).alias("winner"))


@query("""SELECT item_id, [CASE x WHEN 'en' THEN 'English' ELSE 'other' END FOR x IN [lang]] AS mapped, choices[1:2] AS first_two FROM eval_items""")
def filter_map_and_take(spark, d):
    items = table(spark, d, "eval_items")
    mapped = ev.pipeline(F.array("lang"), [("map", {"en": "English"}, "other")])
    return items.select("item_id", mapped.alias("mapped"), ev.pipeline(F.col("choices"), [("take_first_k", 2)]).alias("first_two"))


_BINARY = "b AS (SELECT task_name, item_id, CAST(gold >= 2 AS INTEGER) AS truth, CAST(length(query) % 2 AS INTEGER) AS predicted FROM eval_items)"


def _binary(spark, d):
    return table(spark, d, "eval_items").select("task_name", "item_id", (F.col("gold") >= 2).cast("int").alias("truth"), (F.length("query") % 2).cast("int").alias("predicted"))


@query(f"""WITH {_BINARY}, c AS (SELECT task_name, CAST(count(*) FILTER (WHERE truth = 1 AND predicted = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE truth = 0 AND predicted = 0) AS DOUBLE) AS tn,
        CAST(count(*) FILTER (WHERE truth = 0 AND predicted = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE truth = 1 AND predicted = 0) AS DOUBLE) AS fn FROM b GROUP BY 1)
    SELECT task_name, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c""")
def f1_and_mcc(spark, d):
    rows = _binary(spark, d)
    f1 = rows.groupBy("task_name").agg(ev.AGGREGATIONS["f1"](F.col("truth"), F.col("predicted")).alias("f1"))
    return rounded(f1.join(ev.matthews(rater.confusion(rows, ["task_name"], "truth", "predicted"), ["task_name"]), "task_name"))


@query(f"""WITH {_BINARY}, g AS (SELECT task_name, item_id % 20 AS paragraph, CAST(bool_and(truth = predicted) AS INTEGER) AS ok FROM b GROUP BY 1, 2)
    SELECT task_name, count(*) AS n_groups, round(avg(ok), 6) AS acc_all, round(stddev_samp(ok) / sqrt(count(*)), 6) AS stderr FROM g GROUP BY 1""")
def grouped_accuracy(spark, d):
    rows = _binary(spark, d).withColumn("paragraph", F.col("item_id") % 20)
    return rounded(ev.all_correct(rows, ["task_name"], ["paragraph"], F.col("truth") == F.col("predicted")))


_TREE = {"everything": ["english", "chinese"], "english": ["daily_sense", "logic_steps", "science_choice", "word_math", "passage_yesno"], "chinese": ["zh_exam", "zh_reading"]}
_EDGES = ", ".join(f"('{g}', '{t}')" for g, t in ev.flatten_tree(_TREE))


@query(f"""WITH {_BINARY}, r AS (SELECT task_name AS task, avg(CAST(truth = predicted AS INTEGER)) AS value, count(*) AS n, stddev_samp(CAST(truth = predicted AS INTEGER)) / sqrt(count(*)) AS stderr FROM b GROUP BY 1),
    e(grp, task) AS (VALUES {_EDGES})
    SELECT grp, count(*) AS n_tasks, round(avg(value), 6) AS macro, round(sum(value * n) / sum(n), 6) AS micro, round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 6) AS stderr
    FROM e JOIN r USING (task) GROUP BY 1""")
def group_results(spark, d):
    right = (F.col("truth") == F.col("predicted")).cast("double")
    results = _binary(spark, d).groupBy(F.col("task_name").alias("task")).agg(F.avg(right).alias("value"), F.count("*").alias("n"), ev.AGGREGATIONS["stderr"](right).alias("stderr"))
    return rounded(ev.group_rollup(results, _TREE))


@query(f"""SELECT coalesce(lang, 'none') AS lang, round(exp(-avg(-n_chars / 5000.0)), 6) AS perplexity, round(exp(-sum(-n_chars / 5000.0) / sum(n_chars + 1)), 6) AS weighted_perplexity,
    round(-sum(-n_chars / 5000.0) / sum(strlen(text) + 1) / {math.log(2)!r}, 9) AS bits_per_byte, round(median(n_chars), 6) AS median_chars FROM documents GROUP BY 1""")
def perplexity_aggregates(spark, d):
    docs = table(spark, d, "documents").withColumn("ll", -F.col("n_chars") / 5000.0)
    a, ll = ev.AGGREGATIONS, F.col("ll")
    return docs.groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(
        F.round(a["perplexity"](ll), 6).alias("perplexity"), F.round(a["weighted_perplexity"](ll, F.col("n_chars") + 1), 6).alias("weighted_perplexity"),
        F.round(a["bits_per_byte"](ll, F.octet_length("text") + 1), 9).alias("bits_per_byte"), F.round(a["median"](F.col("n_chars")), 6).alias("median_chars"),
    )


@query(r"""WITH a AS (SELECT item_id, task_name, trim(regexp_replace(regexp_replace(lower(choices[1]), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS p, trim(regexp_replace(regexp_replace(lower(choices[gold + 1]), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM eval_items),
    w AS (SELECT *, [x FOR x IN regexp_split_to_array(p, '\s+') IF x <> ''] AS pw, [x FOR x IN regexp_split_to_array(t, '\s+') IF x <> ''] AS tw FROM a),
    s AS (SELECT *, coalesce(list_sum([least(len([y FOR y IN pw IF y = x]), len([y FOR y IN tw IF y = x])) FOR x IN list_distinct(pw)]), 0) AS same FROM w)
    SELECT task_name, round(avg(CAST(p = t AS INTEGER)), 6) AS exact, round(avg(CASE WHEN same > 0 THEN 2.0 * same / (len(pw) + len(tw)) ELSE 0.0 END), 6) AS f1 FROM s GROUP BY 1""")
def answer_match(spark, d):
    items = table(spark, d, "eval_items")
    p, t = F.col("choices")[0], F.element_at("choices", F.col("gold") + 1)
    rows = items.select("task_name", (fn.answer_form(p) == fn.answer_form(t)).cast("double").alias("exact"), fn.token_f1(p, t).alias("f1"))
    return rounded(rows.groupBy("task_name").agg(F.avg("exact").alias("exact"), F.avg("f1").alias("f1")))


@query(r"""SELECT item_id, [NOT contains(query, ','), len(regexp_extract_all(query, '[0-9A-Za-z_]+')) >= 20, query = lower(query) AND regexp_matches(query, '[a-z]')] AS strict FROM eval_items""")
def instruction_checks(spark, d):
    items = table(spark, d, "eval_items")
    return items.select("item_id", ev.follows(F.col("query"), [("no_comma",), ("min_words", 20), ("all_lower",)]).alias("strict"))


@query("""WITH p AS (SELECT task_name AS task, avg(CAST(gold = 0 AS INTEGER)) AS v, stddev_samp(CAST(gold = 0 AS INTEGER)) / sqrt(count(*)) AS s FROM eval_items GROUP BY 1),
    q AS (SELECT task_name AS task, avg(CAST(gold = 1 AS INTEGER)) AS v, stddev_samp(CAST(gold = 1 AS INTEGER)) / sqrt(count(*)) AS s FROM eval_items GROUP BY 1)
    SELECT p.task, round((p.v - q.v) / sqrt(p.s * p.s + q.s * q.s), 6) AS z FROM p JOIN q USING (task)""")
def run_comparison(spark, d):
    def run(k: int):
        x = (F.col("gold") == k).cast("double")
        return table(spark, d, "eval_items").groupBy(F.col("task_name").alias("task")).agg(F.avg(x).alias("value"), ev.AGGREGATIONS["stderr"](x).alias("stderr"))

    return rounded(ev.compare_runs(run(0), run(1)).select("task", "z"))


@query("SELECT task_name, round(avg(CASE gold WHEN 2 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END), 6) AS win_rate FROM eval_items GROUP BY 1")
def preference_win_rate(spark, d):
    return rounded(table(spark, d, "eval_items").groupBy("task_name").agg(ev.win_rate(F.col("gold")).alias("win_rate")))


@query(r"""SELECT lang, CAST(sum(coalesce(len([x FOR x IN regexp_split_to_array(text, '\s+') IF x <> '']), 0)) AS BIGINT) AS n_tokens, round(sum(coalesce(len([x FOR x IN regexp_split_to_array(text, '\s+') IF x <> '']), 0)) / 1000 * 0.02, 6) AS cost_small FROM documents GROUP BY 1""")
def token_costs(spark, d):
    return rounded(ev.token_cost(table(spark, d, "documents"), ["lang"], fn.trimmed_word_count(F.col("text")), {"small": 0.02}))


@query("""SELECT request_index AS doc_id, list(attempt || ':' || coalesce(status, '') ORDER BY request_id) AS responses FROM gpt_responses GROUP BY 1""")
def responses_by_document(spark, d):
    rows = table(spark, d, "gpt_responses").select(F.col("request_index").alias("doc_id"), F.col("request_id").alias("idx"), F.concat_ws(":", F.col("attempt").cast("string"), F.coalesce("status", F.lit(""))).alias("response"))
    return ev.responses_by_document(rows)


_LISTS = r"""w AS (SELECT task_name, [x FOR x IN regexp_split_to_array(choices[1], '\s+') IF x <> ''] AS p, [x FOR x IN regexp_split_to_array(choices[gold + 1], '\s+') IF x <> ''] AS r FROM eval_items),
    g AS (SELECT task_name, p, r, [p[i] || ' ' || p[i + 1] FOR i IN range(1, len(p))] AS pp, [r[i] || ' ' || r[i + 1] FOR i IN range(1, len(r))] AS rr FROM w)"""
_SAME = "coalesce(list_sum([least(len([y FOR y IN {a} IF y = x]), len([y FOR y IN {b} IF y = x])) FOR x IN list_distinct({a})]), 0)"


@query(f"""WITH {_LISTS}, s AS (SELECT task_name, sum({_SAME.format(a="p", b="r")}) AS m1, sum(len(p)) AS t1, sum({_SAME.format(a="pp", b="rr")}) AS m2, sum(len(pp)) AS t2, sum(len(r)) AS r FROM g GROUP BY 1)
    SELECT task_name, CASE WHEN m1 > 0 AND m2 > 0 THEN round(100 * (CASE WHEN t1 < r THEN exp(1 - r / t1) ELSE 1 END) * exp((ln(m1 / t1) + ln(m2 / t2)) / 2), 6) ELSE 0 END AS bleu FROM s""")
def corpus_bleu(spark, d):
    items = table(spark, d, "eval_items").select("task_name", F.element_at("choices", 1).alias("p"), F.element_at("choices", F.col("gold") + 1).alias("r"))
    return rounded(ev.corpus_bleu(items, ["task_name"], "p", "r", 2))


_STEPS = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(10)]


@query(f"""WITH i AS (SELECT task_name, CAST(gold = 0 AS INTEGER) AS x, iteration, ({draw_sql("0", "item_id", "iteration")} % {1 << 30} + 0.5) / {1 << 30} AS u FROM eval_items, range(0, 200) r(iteration)),
    w AS (SELECT task_name, iteration, x, {" + ".join(f"CAST(u > {s!r} AS INTEGER)" for s in _STEPS)} AS w FROM i),
    a AS (SELECT task_name, iteration, sum(x * w) / sum(w) AS a FROM w GROUP BY 1, 2) SELECT task_name, round(stddev_samp(a), 6) AS stderr FROM a GROUP BY 1""")
def bootstrap_error(spark, d):
    items = table(spark, d, "eval_items").select("task_name", "item_id", (F.col("gold") == 0).cast("double").alias("x"))
    return rounded(ev.bootstrap_stderr(items, ["task_name"], "item_id", "x", lambda x, w: F.sum(x * w) / F.sum(w), 200))
