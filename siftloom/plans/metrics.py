"""Metrics, checks, templates, masks and samplers that no other plan reaches."""

from __future__ import annotations


from pyspark.sql import functions as F

from siftloom.functions import text as fn
from siftloom.functions.numeric import draw_sql
from siftloom.operators import chunk, sample
from siftloom.operators import evaluate as ev
from siftloom.operators import stats as op

from .registry import STATS, query, rounded, stats, table

_FORM = r"trim(regexp_replace(regexp_replace(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_BARE = r"trim(regexp_replace(translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\n+', ' ', 'g'))"
_SAME = "coalesce(list_sum([least(len([y FOR y IN {a} IF y = x]), len([y FOR y IN {b} IF y = x])) FOR x IN list_distinct({a})]), 0)"
_WORDS = r"[x FOR x IN regexp_split_to_array({0}, '\s+') IF x <> '']"


def _f1_sql(a: str, b: str) -> str:
    p, t = _WORDS.format(_FORM.format(a)), _WORDS.format(_FORM.format(b))
    same = _SAME.format(a=p, b=t)
    return f"(CASE WHEN {same} > 0 THEN 2.0 * {same} / (len({p}) + len({t})) ELSE 0.0 END)"


def _items(spark, d):
    return table(spark, d, "eval_items")


@query("SELECT task_name, count(*) AS n, round(avg(CAST(list_contains([0, 2], list_position(s, list_max(s)) - 1) AS INTEGER)), 6) AS acc FROM (SELECT *, [-length(c) / 4.0 FOR c IN choices] AS s FROM eval_items) GROUP BY 1")
def multi_gold_accuracy(spark, d):
    acc = ev.accuracy_multi(F.transform("choices", lambda c: -F.length(c) / 4.0), F.array(F.lit(0), F.lit(2)))
    return rounded(_items(spark, d).groupBy("task_name").agg(F.count("*").alias("n"), F.avg(acc).alias("acc")))


@query(r"""SELECT item_id, CAST(p = t AS DOUBLE) AS em FROM (SELECT item_id, translate(translate(lower(regexp_replace(choices[1], 'e', '', 'g')), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '0123456789', '') AS p,
    translate(translate(lower(regexp_replace(choices[gold + 1], 'e', '', 'g')), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '0123456789', '') AS t FROM eval_items)""")
def exact_match_ignoring(spark, d):
    em = ev.exact_match(F.col("choices")[0], F.element_at("choices", F.col("gold") + 1), True, True, True, ["e"])
    return _items(spark, d).select("item_id", em.alias("em"))


@query(r"""SELECT item_id, [ltrim(x) FOR x IN ['  ' || choices[1], choices[2]]] AS bare, [upper(x) FOR x IN choices[1:1]] AS upper FROM eval_items""")
def filter_spaces_and_upper(spark, d):
    bare = ev.pipeline(F.array(F.concat(F.lit("  "), F.col("choices")[0]), F.col("choices")[1]), [("remove_whitespace",)])
    return _items(spark, d).select("item_id", bare.alias("bare"), ev.pipeline(F.col("choices"), [("uppercase",), ("take_first",)]).alias("upper"))


@query("SELECT item_id, ['(' || chr(65 + CAST(item_id % 4 AS INTEGER)) || ')', '(' || chr(65 + gold) || ')', '[invalid]'] AS picked FROM eval_items WHERE len(list_distinct(choices)) = 4")
def filter_multi_choice(spark, d):
    """An answer by pattern, one by the letter behind a colon, and one without."""
    items = _items(spark, d).where(F.size(F.array_distinct("choices")) == 4)
    letter = lambda n: F.chr(F.lit(65) + n)
    said = F.array(F.concat(F.lit("the answer is ("), letter(F.col("item_id") % 4), F.lit(")")), F.concat(F.lit("it must be: "), letter(F.col("gold"))), F.lit("~~"))
    return items.select("item_id", ev.pipeline(said, [("multi_choice", r"answer is (\([A-D]\))")], F.col("choices")).alias("picked"))


@query(rf"""WITH w AS (SELECT item_id, {_WORDS.format(_BARE.format("choices[1]"))} AS p, {_WORDS.format(_BARE.format("choices[gold + 1]"))} AS t FROM eval_items), s AS (SELECT *, {_SAME.format(a="p", b="t")} AS same FROM w)
    SELECT item_id, round(CASE WHEN same > 0 THEN 2.0 * same / (len(p) + len(t)) ELSE 0.0 END, 6) AS rouge1 FROM s""")
def rouge_one(spark, d):
    return rounded(_items(spark, d).select("item_id", ev.rouge(F.col("choices")[0], F.element_at("choices", F.col("gold") + 1)).alias("rouge1")))


@query(f"""WITH g AS (SELECT item_id, list_max([{_f1_sql("query", "c")} FOR c IN choices[1:2]]) AS good, list_max([{_f1_sql("query", "c")} FOR c IN choices[3:4]]) AS bad FROM eval_items)
    SELECT item_id, round(good, 6) AS best, round(good - bad, 6) AS diff, CAST(good > bad AS DOUBLE) AS acc FROM g""")
def reference_gap(spark, d):
    gap = ev.reference_gap(F.slice("choices", 1, 2), F.slice("choices", 3, 2), lambda r: fn.token_f1(F.col("query"), r))
    return rounded(_items(spark, d).select("item_id", gap.alias("g")).select("item_id", "g.*"))


@query("""WITH s AS (SELECT item_id, gold, [-length(c) / 10.0 FOR c IN choices] AS s FROM eval_items)
    SELECT item_id, round(list_sum([CASE WHEN i <= 2 THEN exp(x - list_max(s)) ELSE 0 END FOR x, i IN s]) / list_sum([exp(x - list_max(s)) FOR x IN s]), 6) AS mass,
           round(abs(s[1] - s[2]), 6) AS likelihood_diff, CAST(s[1] > s[2] AS DOUBLE) AS prefers_first FROM s""")
def true_mass_and_preference(spark, d):
    s = F.transform("choices", lambda c: -F.length(c) / 10.0)
    rows = _items(spark, d).select("item_id", ev.true_mass(s, F.array(*map(F.lit, (1, 1, 0, 0)))).alias("mass"), ev.likelihood_preference(s[0], s[1]).alias("p"))
    return rounded(rows.select("item_id", "mass", "p.*"))


@query("SELECT item_id, [choices[2:4], [choices[1]] || choices[3:4], choices[1:2] || [choices[4]], choices[1:3]] AS others FROM eval_items")
def leave_one_out(spark, d):
    return _items(spark, d).select("item_id", ev.leave_one_out(F.col("choices")).alias("others"))


@query("""WITH r AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n, query FROM eval_items)
    SELECT coalesce(lang, 'none') AS lang, m.metric, round(CASE m.metric WHEN 'bits_per_byte' THEN sum(n_chars / 100.0) / sum(strlen(text)) / ln(2) WHEN 'byte_perplexity' THEN exp(sum(n_chars / 100.0) / sum(strlen(text))) ELSE exp(sum(n_chars / 100.0) / sum(len(regexp_split_to_array(text, '\\s+')))) END, 6) AS value
    FROM documents, (VALUES ('word_perplexity'), ('byte_perplexity'), ('bits_per_byte')) m(metric) WHERE text IS NOT NULL GROUP BY 1, 2""")
def rolling_perplexities(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), "text", (-F.col("n_chars") / 100).alias("ll"))
    rows = ev.rolling_rows(docs, "doc_id", "ll", "text").join(docs.select("doc_id", "lang"), "doc_id")
    return rounded(ev.rolling_metrics(rows, ["lang"]))


@query("SELECT item_id, round(-list_sum([length(c) / 8.0 FOR c IN choices]), 6) AS loglikelihood, len([c FOR c IN choices IF length(c) > 3]) = 4 AS is_greedy FROM eval_items")
def loglikelihood_rows(spark, d):
    rows = _items(spark, d).select("item_id", F.transform("choices", lambda c: -F.length(c) / 8.0).alias("lp"), F.transform("choices", lambda c: F.length(c) > 3).alias("g"))
    return rounded(ev.loglikelihood_rows(rows, "item_id", "lp", "g"))


@query("SELECT task_name, count(*) AS n, round(avg(CAST(length(c) % 2 = 0 AS INTEGER)), 6) AS acc FROM (SELECT task_name, unnest(choices) AS c FROM eval_items) GROUP BY 1")
def flat_accuracy(spark, d):
    rows = _items(spark, d).withColumn("ok", F.transform("choices", lambda c: F.length(c) % 2 == 0))
    return rounded(ev.flat_accuracy(rows, ["task_name"], "ok"))


@query(f"""WITH r AS (SELECT task_name, list_max([CAST({_FORM.format("choices[1]")} = {_FORM.format("c")} AS INTEGER) FOR c IN choices[2:4]]) AS e, list_max([{_f1_sql("choices[1]", "c")} FOR c IN choices[2:4]]) AS f FROM eval_items)
    SELECT task_name, count(*) AS n, round(avg(e), 6) AS em, round(avg(f), 6) AS f1 FROM r GROUP BY 1""")
def best_reference_scores(spark, d):
    rows = _items(spark, d).select("task_name", F.col("choices")[0].alias("p"), F.slice("choices", 2, 3).alias("refs"))
    return rounded(ev.reference_scores(rows, ["task_name"], "p", "refs"))


@query("""WITH x AS (SELECT task_name, gold AS t, length(query) % 3 AS p FROM eval_items), c AS (SELECT task_name, k, count(*) FILTER (WHERE t = k AND p = k) AS b, count(*) FILTER (WHERE t = k) + count(*) FILTER (WHERE p = k) AS n FROM x, (VALUES (0), (1), (2)) v(k) GROUP BY 1, 2)
    SELECT task_name, round(avg(CASE WHEN n > 0 THEN 2.0 * b / n ELSE 0.0 END), 6) AS f1 FROM c GROUP BY 1""")
def one_vs_rest_f1(spark, d):
    return rounded(ev.mean_class_f1(_items(spark, d), ["task_name"], F.col("gold"), F.length("query") % 3, [0, 1, 2]))


@query(rf"""WITH w AS (SELECT item_id, {_WORDS.format("choices[1]")} AS p, {_WORDS.format("choices[gold + 1]")} AS r FROM eval_items), g AS (SELECT *, [p[i] || ' ' || p[i + 1] FOR i IN range(1, len(p))] AS pp, [r[i] || ' ' || r[i + 1] FOR i IN range(1, len(r))] AS rr FROM w),
    s AS (SELECT *, {_SAME.format(a="p", b="r")} AS m1, {_SAME.format(a="pp", b="rr")} AS m2 FROM g)
    SELECT item_id, CASE WHEN m1 > 0 THEN round(100 * (CASE WHEN len(p) < len(r) THEN exp(1 - len(r) / len(p)) ELSE 1 END) * exp((ln(m1 / len(p)) + ln((m2 + 1) / (len(pp) + 1))) / 2), 6) ELSE 0 END AS bleu FROM s""")
def sentence_bleu(spark, d):
    rows = _items(spark, d).select("item_id", F.col("choices")[0].alias("p"), F.element_at("choices", F.col("gold") + 1).alias("r"))
    return rounded(ev.smoothed_bleu(rows, "item_id", "p", "r", 2))


@query("""SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS answer_no, answer FROM (SELECT item_id, answer, min(i) AS i FROM (SELECT item_id, unnest(a) AS answer, generate_subscripts(a, 1) AS i
    FROM (SELECT item_id, choices || [choices[1]] AS a FROM eval_items)) GROUP BY 1, 2)""")
def distinct_answers(spark, d):
    rows = _items(spark, d).select("item_id", F.concat("choices", F.slice("choices", 1, 1)).alias("a"))
    return ev.exploded_answers(rows, "item_id", "a")


@query("SELECT task_name, gold, count(*) AS n, list(item_id ORDER BY item_id) AS keys FROM eval_items GROUP BY 1, 2")
def grouped_requests(spark, d):
    return ev.grouped_requests(_items(spark, d), ["task_name", "gold"], "item_id")


@query("""WITH a AS (SELECT task_name AS task, 'acc' AS metric, avg(CAST(gold = 0 AS INTEGER)) AS v FROM eval_items WHERE gold < 3 GROUP BY 1), b AS (SELECT task_name AS task, 'acc' AS metric, avg(CAST(gold = 1 AS INTEGER)) AS v FROM eval_items WHERE lang = 'en' GROUP BY 1)
    SELECT coalesce(a.task, b.task) AS task, 'acc' AS metric, round(a.v, 6) AS before, round(b.v, 6) AS after, round(b.v - a.v, 6) AS diff,
           CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN b.v - a.v > 0.01 THEN 'better' WHEN b.v - a.v < -0.01 THEN 'worse' ELSE 'same' END AS verdict FROM a FULL OUTER JOIN b ON a.task = b.task""")
def regression_table(spark, d):
    run = lambda where, k: _items(spark, d).where(where).groupBy(F.col("task_name").alias("task")).agg(F.avg((F.col("gold") == k).cast("double")).alias("value")).withColumn("metric", F.lit("acc"))
    return rounded(ev.regression_table(run("gold < 3", 0), run("lang = 'en'", 1), 0.01))


@query(r"""SELECT item_id, 'Q: ' || regexp_replace(query, '[0-9]+', '#', 'g') || chr(10) || 'A: ' || upper(choices[gold + 1]) || ' (' || trim(lang) || ')' AS text, choices[1] AS first FROM eval_items""")
def rendered_templates(spark, d):
    items = _items(spark, d)
    text = ev.resolve("Q: {{query | regex_replace('[0-9]+', '#')}}\nA: {{choices[gold] | upper}} ({{ lang|trim }})", items.columns)
    return items.select("item_id", text.alias("text"), ev.resolve("{{choices[0]}}", items.columns).alias("first"))


@query("""WITH p AS (SELECT task_name, item_id, query, row_number() OVER (PARTITION BY task_name ORDER BY item_id) AS place FROM eval_items),
    s AS (SELECT e.item_id, p.query, p.place, row_number() OVER (PARTITION BY e.item_id ORDER BY p.place) AS shot FROM eval_items e JOIN p ON p.task_name = e.task_name AND p.item_id <> e.item_id)
    SELECT e.item_id, md5('Read.' || string_agg(s.query, chr(10) || chr(10) ORDER BY s.shot) || chr(10) || chr(10) || any_value(e.query)) AS digest FROM eval_items e JOIN s ON s.item_id = e.item_id WHERE shot <= 2 GROUP BY 1""")
def fewshot_contexts(spark, d):
    items = _items(spark, d)
    shots = sample.fewshot(items, items, "task_name", "item_id", 2, [F.col("example")]).join(items.select(F.col("item_id").alias("example"), F.col("query").alias("text")), "example")
    per = shots.groupBy("item_id").agg(F.collect_list(F.struct(F.col("shot").cast("int").alias("shot"), "text")).alias("x"))
    return items.join(per, "item_id").select("item_id", F.md5(ev.fewshot_context(F.lit("Read."), F.col("x"), F.col("query"))).alias("digest"))


@query(f"""WITH p AS (SELECT task_name, item_id AS example, row_number() OVER (PARTITION BY task_name ORDER BY {draw_sql("3", "item_id")}, item_id) AS place, count(*) OVER (PARTITION BY task_name) AS n FROM eval_items),
    t AS (SELECT e.item_id, e.task_name, p.n, k, ({draw_sql("3", "'start'", "e.item_id")} + k) % p.n + 1 AS place FROM eval_items e JOIN (SELECT DISTINCT task_name, n FROM p) p USING (task_name), range(0, 4) r(k) WHERE k <= least(3, p.n - 1)),
    f AS (SELECT t.item_id, p.example, row_number() OVER (PARTITION BY t.item_id ORDER BY k) AS shot FROM t JOIN p ON p.task_name = t.task_name AND p.place = t.place WHERE p.example <> t.item_id)
    SELECT item_id, CAST(shot AS INTEGER) AS shot, example FROM f WHERE shot <= 3""")
def fewshot_drawn(spark, d):
    items = _items(spark, d)
    return sample.fewshot_random(items, items, "task_name", "item_id", 3, 3)


@query(f"SELECT document_index FROM (SELECT document_index, row_number() OVER (ORDER BY {draw_sql('9', 'document_index')}, document_index) AS n FROM documents) WHERE n <= 200")
def sample_of_exact_size(spark, d):
    return sample.sample_exactly(table(spark, d, "documents").select("document_index"), 200, "document_index", 9)


@query(f"""WITH h AS (SELECT item_id, unnest(choices) AS c, generate_subscripts(choices, 1) - 1 AS i FROM eval_items) SELECT item_id, list(c ORDER BY {draw_sql("4", "item_id", "i", "c")}, i) AS choices FROM h GROUP BY 1""")
def shuffled_choices(spark, d):
    return _items(spark, d).select("item_id", sample.shuffled_choices(F.col("choices"), F.col("item_id"), 4).alias("choices"))


@query(r"SELECT item_id, w[1:least(3, len(w) - 1)] AS context, w[4:] AS targets FROM (SELECT item_id, regexp_extract_all(query, '\S+') AS w FROM eval_items)")
def disjoint_context(spark, d):
    """Inputs shifted by one against their targets, cut where the targets begin."""
    w = F.regexp_extract_all("query", F.lit(r"\S+"), F.lit(0))
    inputs, targets = chunk.disjoint(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(4), F.size(w)))
    return _items(spark, d).select("item_id", inputs.alias("context"), targets.alias("targets"))


_TOKENS = r"(SELECT item_id, task_name, [length(x) FOR x IN regexp_extract_all(query, '\S+')] AS p, [length(x) FOR x IN regexp_extract_all(choices[gold + 1], '\S+')] AS r FROM eval_items)"


def _tokens(spark, d):
    count = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)), F.length)
    return _items(spark, d).select("item_id", "task_name", count(F.col("query")).alias("p"), count(F.element_at("choices", F.col("gold") + 1)).alias("r"))


@query(f"SELECT item_id, p || r AS input_ids, [-100 FOR x IN p] || r AS labels FROM {_TOKENS}")
def prompt_loss_mask(spark, d):
    return _tokens(spark, d).select("item_id", chunk.loss_mask(F.col("p"), F.col("r"), 1 << 30).alias("m")).select("item_id", "m.*")


@query(f"""WITH m AS (SELECT *, max(len(p)) OVER (PARTITION BY task_name) AS most FROM {_TOKENS})
    SELECT item_id, p || [0 FOR x IN range(len(p), most)] AS p, [1 FOR x IN p] || [0 FOR x IN range(len(p), most)] AS attention_mask FROM m""")
def padded_batches(spark, d):
    return chunk.pad_batches(_tokens(spark, d).select("item_id", "task_name", "p"), "p", "task_name").select("item_id", "p", "attention_mask")


@query(f"SELECT item_id, CAST({draw_sql('42', 'item_id')} % (greatest(len(p) - 8, 0) + 1) AS INTEGER) AS start, p[CAST({draw_sql('42', 'item_id')} % (greatest(len(p) - 8, 0) + 1) AS INTEGER) + 1 : CAST({draw_sql('42', 'item_id')} % (greatest(len(p) - 8, 0) + 1) AS INTEGER) + 8] AS p FROM {_TOKENS}")
def random_chunks(spark, d):
    rows = _tokens(spark, d).select("item_id", "p")
    return chunk.random_chunk(rows.withColumn("start", chunk.random_start(F.size("p"), 8, F.col("item_id"))), "p", 8, "item_id")


@query(f"SELECT item_id, p AS restored FROM {_TOKENS}")
def infilled_spans(spark, d):
    """Spans replaced by marks and put back from what the marks stand for: every token comes back in its place."""
    marks = list(range(-1, -101, -1))
    rows = chunk.span_infill(_tokens(spark, d).select("item_id", "p"), "p", "item_id", marks)
    return rows.select("item_id", chunk.span_restore(F.col("input_ids"), F.col("labels")).alias("restored"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(replace(trim(text, ' '), ' [title]', '. '), '\[[^\n\r\x{85}\x{2028}\x{2029}]*?\]', '', 'g'), '  ', ' ', 'g')) AS titled,
    md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, ' ''', ''''), ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10)), ' n''t', 'n''t'), '`` ', '"'), '''''', '"'), ' :', ':'), ' ;', ';'), ' !', '!'), ' ?', '?'), ' ,', ','), ' .', '.')) AS dialogue FROM documents""")
def detokenize_others(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(fn.hellaswag_detokenize(t)).alias("titled"), F.md5(fn.dialogue_detokenize(t)).alias("dialogue"))


@query("""SELECT item_id, [x FOR x IN string_split(lang || '::' || task_name, '::')] AS parts, md5(CASE WHEN gold = 0 THEN '<' || query || '>' ELSE '<' || query || '|' || choices[1] || '>' END) AS prompt,
    round(CASE WHEN gold = 0 THEN 0 WHEN gold * 2 <= 5 THEN 6.5 / (1 + exp(-1.2 * (gold * 2 - 4))) ELSE gold * 2 END, 6) AS emotion FROM eval_items""")
def small_functions(spark, d):
    """Escaped split, prompt with or without input, and the emotion scale."""
    prompt = fn.instruction_prompt(F.col("query"), F.when(F.col("gold") > 0, F.col("choices")[0]), "<{instruction}|{input}>", "<{instruction}>")
    parts = fn.escaped_split(F.concat("lang", F.lit("::"), "task_name"), "::")
    return rounded(_items(spark, d).select("item_id", parts.alias("parts"), F.md5(prompt).alias("prompt"), fn.emotion_scale(F.col("gold") * 2.0).alias("emotion")))


@query(f"""WITH {STATS} SELECT source, coalesce(CASE WHEN overall_score > 3 THEN 'high' WHEN overall_score = 3 THEN 'middle' WHEN overall_score < 3 THEN 'low' END, 'none') AS class, count(*) AS n FROM stats GROUP BY 1, 2""")
def three_way_classes(spark, d):
    rows = stats(spark, d).select("source", F.coalesce(op.score_classes(F.col("overall_score"))[1], F.lit("none")).alias("class"))
    return rows.groupBy("source", "class").agg(F.count("*").alias("n"))


@query(r"""SELECT item_id, [len(regexp_extract_all(lower(query), 'the')) >= 2, length(query) - length(translate(lower(query), 'e', '')) >= 5, len(regexp_extract_all(query, '\b[A-Z]+\b')) >= 2, starts_with(lower(trim(query || ' x')), lower(trim(query))),
    contains(trim(query), 'which') OR contains(trim(query), '哪'), regexp_matches(lower(query), 'p\.\s?s\.')] AS strict FROM eval_items""")
def instruction_checks_more(spark, d):
    checks = [("keyword_times", "the", 2), ("letter_times", "e", 5), ("capital_words", 2)]
    q = F.col("query")
    rest = [ev.CHECKS["repeats_prompt"](F.concat(q, F.lit(" x")), q), ev.CHECKS["one_of"](q, "which", "哪"), ev.CHECKS["postscript"](q, "P.S.")]
    return _items(spark, d).select("item_id", F.concat(ev.follows(q, checks), F.array(*rest)).alias("strict"))


@query("""WITH x AS (SELECT item_id, gold < 2 AS has, (item_id * 7919 % 1000) / 1000.0 AS p, CAST(choices[1] = choices[gold + 1] AS INTEGER) AS ok FROM eval_items),
    r AS (SELECT *, sum(CASE WHEN has THEN ok ELSE -1 END) OVER (ORDER BY p, item_id ROWS UNBOUNDED PRECEDING) AS gain FROM x),
    b AS (SELECT max(gain) AS g FROM r)
    SELECT round(100.0 * ((SELECT count(*) FROM x WHERE NOT has) + greatest(g, 0)) / (SELECT count(*) FROM x), 6) AS best_exact, CASE WHEN g > 0 THEN (SELECT p FROM r WHERE gain = g ORDER BY p, item_id LIMIT 1) ELSE 0.0 END AS best_exact_thresh FROM b""")
def answer_thresholds(spark, d):
    """The best threshold on a no-answer probability; here answers are told by the whole choice."""
    rows = _items(spark, d).select(
        "item_id", F.col("choices")[0].alias("p"), F.when(F.col("gold") < 2, F.array(F.element_at("choices", F.col("gold") + 1))).otherwise(F.array().cast("array<string>")).alias("refs"), ((F.col("item_id") * 7919 % 1000) / 1000.0).alias("na")
    )
    return rounded(ev.squad_thresholds(rows, "p", "refs", "na", "item_id").select("best_exact", "best_exact_thresh"))


@query("SELECT task_name, round(avg(CASE WHEN gold = 0 THEN 1.0 WHEN gold = 1 THEN 0.5 ELSE 0.0 END), 6) AS bag FROM eval_items GROUP BY 1")
def bag_alignment(spark, d):
    """Bags of one word each: the same, one of two, and another."""
    g = F.col("gold")
    p = F.when(g == 0, F.array(F.lit("red"))).when(g == 1, F.array(F.lit("red"), F.lit("blue"))).otherwise(F.array(F.lit("green")))
    return rounded(_items(spark, d).select("task_name", ev.bag_f1_of(p, F.array(F.lit("red"))).alias("x")).groupBy("task_name").agg(F.avg("x").alias("bag")))


@query("SELECT item_id, CAST(length(query) AS VARCHAR) AS boxed, gold = 1 AS equal FROM eval_items")
def maths_answers(spark, d):
    """The last boxed part of a solution, and answers that are equal in normal form."""
    solution = F.concat(F.lit("so \\boxed{0} or \\boxed{"), F.length("query").cast("string"), F.lit("}."))
    equal = ev.latex_equal(F.when(F.col("gold") == 1, F.lit("\\dfrac12")).otherwise(F.lit("\\frac13")), F.lit("0.5"))
    return _items(spark, d).select("item_id", ev.boxed(solution).alias("boxed"), equal.alias("equal"))


