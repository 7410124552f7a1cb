"""Evaluation: response filters, metrics of a document, aggregations with errors, group roll-up."""

from __future__ import annotations

import fnmatch
import math
from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.numeric import draw, ratio
from siftloom.functions.text import PUNCTUATION, softmax

# ---- response filters: array of responses to array of responses -------------------------------------------------

FILTERS: dict[str, Callable[..., Callable[[Column], Column]]] = {}


def response_filter(name: str):
    def keep(make):
        FILTERS[name] = make
        return make

    return keep


def first_group(text: Column, pattern: str, groups: int, select: int = 0, fallback: str = "[invalid]") -> Column:
    """Match number ``select`` (negative: from the end) of a pattern, its first non-empty group, stripped; else the fallback."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (range(1, groups + 1) if groups else [0])]
    at = lambda a: F.try_element_at(a, F.lit(select + 1 if select >= 0 else select))
    picked = F.coalesce(*[F.when(at(a) != "", at(a)) for a in found])
    return F.coalesce(F.trim(picked), F.lit(fallback))


@response_filter("regex")
def regex(pattern: str, groups: int = 1, select: int = 0, fallback: str = "[invalid]"):
    return lambda r: F.transform(r, lambda x: first_group(x, pattern, groups, select, fallback))


@response_filter("remove_whitespace")
def remove_whitespace():
    return lambda r: F.transform(r, lambda x: F.regexp_replace(x, r"^\s+", ""))


@response_filter("take_first")
def take_first():
    return lambda r: F.slice(r, 1, 1)


@response_filter("take_first_k")
def take_first_k(k: int):
    return lambda r: F.slice(r, 1, k)


@response_filter("majority_vote")
def majority_vote():
    """The most frequent response, of equal ones the first seen."""

    def vote(r: Column) -> Column:
        count = lambda w: F.size(F.filter(r, lambda x: x.eqNullSafe(w)))
        counted = F.transform(F.array_distinct(r), lambda w: F.struct((-count(w)).alias("n"), F.coalesce(F.array_position(r, w), F.lit(0)).alias("at"), w.alias("w")))
        return F.when(F.size(r) > 0, F.array(F.array_min(counted)["w"])).otherwise(r)

    return vote


@response_filter("lowercase")
def lowercase():
    return lambda r: F.transform(r, F.lower)


@response_filter("uppercase")
def uppercase():
    return lambda r: F.transform(r, F.upper)


@response_filter("map")
def mapped(pairs: Mapping[str, str], default: str):
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return lambda r: F.transform(r, lambda x: F.coalesce(F.try_element_at(table, x), F.lit(default)))


@response_filter("multi_choice")
def multi_choice(pattern: str, select: int = 0, fallback: str = "[invalid]", ignore_case: bool = False, ignore_punctuation: bool = False, ignore: Sequence[str] = ()):
    """A function of (responses, choices), arrays both, that finds ``(A)`` by pattern, else by the text of a choice, else by ``: A``."""
    import re

    def clean(s: str) -> str:
        for p in ignore:
            s = re.sub(p, "", s)
        s = s.lower() if ignore_case else s
        return s.translate(str.maketrans("", "", PUNCTUATION)) if ignore_punctuation else s

    def pick(rx: re.Pattern, text: str, names: dict[str, str]) -> str | None:
        found = rx.findall(text)
        if not found or not -len(found) <= select < len(found):
            return None
        hit = found[select]
        hit = next((g for g in hit if g), "") if isinstance(hit, tuple) else hit
        hit = hit.strip()
        return names.get(hit, hit) if hit else None

    first = re.compile(pattern)

    @F.pandas_udf("array<string>")
    def run(responses: pd.Series, choices: pd.Series) -> pd.Series:
        out = []
        for rs, cs in zip(responses, choices):
            letters = [chr(65 + i) for i in range(len(cs) if cs is not None else 0)]
            texts = {clean(c.strip()): f"({a})" for a, c in zip(letters, cs)} if letters else {}
            by_text = re.compile("|".join(re.escape(t) for t in texts if t) or r"(?!)")
            by_letter = re.compile(r":[\s]*(" + ("|".join(letters) or "(?!)") + ")")
            got = []
            for r in rs if rs is not None else []:
                r = r or ""
                got.append(pick(first, r, {}) or pick(by_text, clean(r), texts) or pick(by_letter, r, {a: f"({a})" for a in letters}) or fallback)
            out.append(got)
        return pd.Series(out)

    return run


def pipeline(responses: Column, steps: Iterable[tuple], choices: Column | None = None) -> Column:
    """Filters in order: each a name with its arguments; ``multi_choice`` reads the ``choices`` of the document too."""
    for name, *args in steps:
        made = FILTERS[name](*args)
        responses = made(responses, choices) if name == "multi_choice" else made(responses)
    return responses


# ---- metrics of one document ------------------------------------------------------------------------------------


def argmax(scores: Column) -> Column:
    """0-based place of the greatest score, the first of equals; null for none."""
    return F.array_position(scores, F.array_max(scores)) - 1


def accuracy(scores: Column, gold: Column) -> Column:
    """1 if the greatest score is the gold one; a gold out of range scores 0."""
    return F.coalesce((argmax(scores) == gold) & (gold >= 0) & (gold < F.size(scores)), F.lit(False)).cast("double")


def accuracy_multi(scores: Column, golds: Column) -> Column:
    return F.coalesce(F.array_contains(golds, argmax(scores).cast("int")), F.lit(False)).cast("double")


def accuracy_norm(scores: Column, choices: Column, gold: Column) -> Column:
    """Accuracy of the scores per character of the choice."""
    return accuracy(F.zip_with(scores, choices, lambda s, c: ratio(s, F.length(c))), gold)


def accuracy_mutual(scores: Column, unconditional: Column, gold: Column) -> Column:
    """Accuracy of the scores less the unconditional ones, paired by option."""
    return accuracy(F.zip_with(scores, unconditional, lambda a, b: a - b), gold)


def brier(scores: Column, gold: Column) -> Column:
    """Sum of squared distances between the softmax and the gold option."""
    p = F.transform(softmax(scores), lambda x, i: F.pow(x - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + x)


def exact_match(prediction: Column, reference: Column, ignore_case=False, ignore_punctuation=False, ignore_numbers=False, ignore: Sequence[str] = ()) -> Column:
    def form(c: Column) -> Column:
        for p in ignore:
            c = F.regexp_replace(c, p, "")
        c = F.lower(c) if ignore_case else c
        c = F.translate(c, PUNCTUATION, "") if ignore_punctuation else c
        return F.translate(c, "0123456789", "") if ignore_numbers else c

    return F.coalesce(form(prediction) == form(reference), F.lit(False)).cast("double")


def gold_rank(scores: Column, gold: Column) -> Column:
    """1-based rank of the gold option: 1 plus the options with a greater score."""
    return 1 + F.size(F.filter(scores, lambda s: s > F.element_at(scores, gold + 1)))


def best_over(references: Column, metric: Callable[[Column], Column]) -> Column:
    """Greatest value of a metric over several references."""
    return F.array_max(F.transform(references, metric))


# ---- aggregations -----------------------------------------------------------------------------------------------

AGGREGATIONS: dict[str, Callable[..., Column]] = {
    "mean": lambda x: F.avg(x),
    "median": lambda x: F.percentile(x, F.lit(0.5)),
    "perplexity": lambda ll: F.exp(-F.avg(ll)),
    "weighted_perplexity": lambda ll, w: F.exp(-ratio(F.sum(ll), F.sum(w))),
    "bits_per_byte": lambda ll, n: -ratio(F.sum(ll), F.sum(n)) / math.log(2),
    "bypass": lambda x: F.lit(999.0),
    "brier_score": lambda b: F.avg(b),
    "stddev_pop": lambda x: F.stddev_pop(x),
    "stddev": lambda x: F.stddev_samp(x),
    "stderr": lambda x: ratio(F.stddev_samp(x), F.sqrt(F.count(x))),
    "weighted_mean": lambda x, w: ratio(F.sum(x * w), F.sum(w)),
}


def binary_f1(gold: Column, predicted: Column) -> Column:
    """F1 of class 1; 0 where undefined."""
    both, either = F.count_if((gold == 1) & (predicted == 1)), F.count_if(gold == 1) + F.count_if(predicted == 1)
    return F.when(either > 0, 2.0 * both / either).otherwise(F.lit(0.0))


AGGREGATIONS["f1"] = binary_f1


def matthews(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, mcc`` of any number of classes from ``by, truth, predicted, n``; 0 where undefined."""
    true = counts.groupBy(*by, F.col("truth").alias("k")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("c"))
    pred = counts.groupBy(*by, F.col("predicted").alias("k")).agg(F.sum("n").alias("p"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c)
    both = true.join(pred, [*by, "k"], "full_outer").select(*by, z("t"), z("p"), z("c"))
    s, c = F.sum("t"), F.sum("c")
    below = F.sqrt((s * s - F.sum(F.col("p") * F.col("p"))) * (s * s - F.sum(F.col("t") * F.col("t"))))
    top = c * s - F.sum(F.col("t") * F.col("p"))
    return both.groupBy(*by).agg(F.when(below > 0, top / below).otherwise(F.lit(0.0)).alias("mcc"))


def all_correct(df: DataFrame, by: Sequence[str], group: Sequence[str], right: Column) -> DataFrame:
    """``by, n_groups, acc_all, stderr``: share of groups whose answers are all right; both use the same groups."""
    each = df.groupBy(*by, *group).agg(F.bool_and(right).cast("double").alias("ok"))
    return each.groupBy(*by).agg(F.count("*").alias("n_groups"), F.avg("ok").alias("acc_all"), (F.stddev_samp("ok") / F.sqrt(F.count("*"))).alias("stderr"))


def corpus_bleu(df: DataFrame, by: Sequence[str], prediction: str, reference: str, order: int = 4) -> DataFrame:
    """``by, bleu`` (0 to 100) of whitespace tokens: clipped n-gram counts summed over the corpus, with brevity penalty."""
    from siftloom.functions.text import multiset_overlap, word_ngrams, words

    cols = []
    for n in range(1, order + 1):
        a, b = word_ngrams(F.col(prediction), n), word_ngrams(F.col(reference), n)
        cols += [multiset_overlap(a, b).alias(f"m{n}"), F.size(a).alias(f"t{n}")]
    rows = df.select(*by, *cols, F.size(words(F.col(reference))).alias("r"))
    sums = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in [*(f"{x}{n}" for n in range(1, order + 1) for x in "mt"), "r"]])
    logs = sum((F.log(F.col(f"m{n}") / F.col(f"t{n}")) for n in range(1, order + 1)), F.lit(0.0)) / order
    penalty = F.when(F.col("t1") < F.col("r"), F.exp(1 - F.col("r") / F.col("t1"))).otherwise(F.lit(1.0))
    some = F.least(*[F.col(f"m{n}") for n in range(1, order + 1)]) > 0
    return sums.select(*by, F.when(some, 100.0 * penalty * F.exp(logs)).otherwise(F.lit(0.0)).alias("bleu"))


def _chrf_counts(p: str, r: str, order: int) -> list[float]:
    from collections import Counter

    p, r = "".join(p.split()), "".join(r.split())
    out = []
    for n in range(1, order + 1):
        a, b = Counter(p[i : i + n] for i in range(len(p) - n + 1)), Counter(r[i : i + n] for i in range(len(r) - n + 1))
        out += [sum((a & b).values()), sum(a.values()), sum(b.values())]
    return [float(x) for x in out]


def corpus_chrf(df: DataFrame, by: Sequence[str], prediction: str, reference: str, order: int = 6, beta: float = 2.0) -> DataFrame:
    """``by, chrf`` (0 to 100): character n-gram F-beta from counts summed over the corpus."""

    @F.pandas_udf("array<double>")
    def counts(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([_chrf_counts(a or "", b or "", order) for a, b in zip(p, r)])

    rows = df.select(*by, counts(prediction, reference).alias("c"))
    sums = rows.groupBy(*by).agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(3 * order)])
    parts = []
    for n in range(order):
        m, a, b = (F.col(f"c{3 * n + i}") for i in range(3))
        precision, recall = m / F.nullif(a, F.lit(0.0)), m / F.nullif(b, F.lit(0.0))
        parts.append(F.when((a > 0) & (b > 0), F.coalesce((1 + beta**2) * precision * recall / F.nullif(beta**2 * precision + recall, F.lit(0.0)), F.lit(0.0))))
    used = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    return sums.select(*by, F.when(used > 0, 100.0 * sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / used).otherwise(F.lit(0.0)).alias("chrf"))


def corpus_ter(df: DataFrame, by: Sequence[str], prediction: str, reference: str) -> DataFrame:
    """``by, ter``: word edits (without shifts) per reference word, in percent, over the corpus."""

    @F.pandas_udf("long")
    def edits(p: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(p, r):
            a, b = (a or "").split(), (b or "").split()
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                last, row[0] = row[0], i
                for j, y in enumerate(b, 1):
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
            out.append(row[-1])
        return pd.Series(out)

    from siftloom.functions.text import words

    rows = df.select(*by, edits(prediction, reference).alias("e"), F.size(words(F.col(reference))).alias("w"))
    return rows.groupBy(*by).agg((100.0 * F.sum("e") / F.greatest(F.sum("w"), F.lit(1))).alias("ter"))


# ---- standard errors --------------------------------------------------------------------------------------------


def bootstrap_stderr(df: DataFrame, by: Sequence[str], key: str, value: str, aggregate: Callable[[Column, Column], Column], iterations: int = 1000, seed: int = 0) -> DataFrame:
    """``by, stderr``: sample deviation of an aggregation over resamples.

    Each row enters each resample a Poisson(1) number of times, drawn from its ``key`` alone,
    so a resample needs no join, rows stay where they are, and the result does not follow
    their partitions. ``aggregate`` takes the value and its weight. Rows multiply by
    ``iterations`` before the partial aggregation, which keeps one row a resample and task.
    """
    steps, p = [], math.exp(-1)  # cumulative probabilities of a Poisson variable of mean 1
    for k in range(10):
        p = p / k if k else p
        steps.append(p + (steps[-1] if k else 0.0))
    u = (draw(F.lit(seed), F.col(key), F.col("iteration")) % (1 << 30) + 0.5) / (1 << 30)
    drawn = df.select(*by, key, value, F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iteration")).withColumn("u", u)
    weight = sum((F.when(F.col("u") > s, 1).otherwise(0) for s in steps), F.lit(0))
    per = drawn.withColumn("weight", weight).groupBy(*by, "iteration").agg(aggregate(F.col(value), F.col("weight")).alias("a"))
    return per.groupBy(*by).agg(F.stddev_samp("a").alias("stderr"))


def stderr_kind(metric: str, iterations: int) -> tuple[str, int]:
    """How the error of a metric is found: ``closed``, ``bootstrap`` with so many resamples, or ``none``."""
    if metric in ("mean", "acc_all"):
        return "closed", 0
    if metric in ("median", "perplexity", "f1", "matthews_corrcoef", "bleu", "chrf", "ter"):
        return ("bootstrap", min(iterations, 100) if metric in ("bleu", "chrf", "ter") else iterations) if iterations > 0 else ("none", 0)
    return "none", 0


def pooled_stderr(results: DataFrame, by: Sequence[str], stderr: str = "stderr", n: str = "n") -> DataFrame:
    """``by, stderr`` of subtasks pooled: sqrt(sum((n-1) se^2 n) / (sum(n) - k) / sum(n))."""
    se, size = F.col(stderr), F.col(n)
    inside = ratio(ratio(F.sum((size - 1) * se * se * size), F.sum(size) - F.count("*")), F.sum(size))
    return results.groupBy(*by).agg(F.sqrt(inside).alias("stderr"))


# ---- groups -----------------------------------------------------------------------------------------------------


def flatten_tree(tree: Mapping[str, Sequence]) -> list[tuple[str, str]]:
    """(group, leaf task) of a tree given as group -> names of tasks or groups; each leaf once a group."""
    out = []

    def leaves(name: str, above: tuple[str, ...]) -> list[str]:
        if name in above:
            raise ValueError(f"{name!r} contains itself")
        if name not in tree:
            return [name]
        return list(dict.fromkeys(x for child in tree[name] for x in leaves(child, (*above, name))))

    for group in tree:
        out += [(group, leaf) for leaf in leaves(group, ())]
    return out


def group_rollup(results: DataFrame, tree: Mapping[str, Sequence], value: str = "value", n: str = "n") -> DataFrame:
    """``grp, n_tasks, macro, micro, stderr``: plain mean, mean weighted by size, and pooled error of each group's tasks."""
    edges = results.sparkSession.createDataFrame(flatten_tree(tree), "grp string, task string")
    joined = results.join(F.broadcast(edges), "task")
    se = F.col("stderr")
    inside = F.sum((F.col(n) - 1) * se * se * F.col(n)) / F.nullif(F.sum(n) - F.count("*"), F.lit(0)) / F.sum(n)
    return joined.groupBy("grp").agg(F.count("*").alias("n_tasks"), F.avg(value).alias("macro"), (F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("micro"), F.sqrt(inside).alias("stderr"))


def match_names(patterns: Sequence[str], names: Sequence[str]) -> list[str]:
    """Names that match any wildcard pattern, sorted, each once."""
    return sorted({n for p in patterns for n in names if fnmatch.fnmatchcase(n, p)})


def responses_by_document(instances: DataFrame) -> DataFrame:
    """``doc_id, responses``: the responses of each document in the order of ``idx``."""
    return instances.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "response"))), lambda s: s["response"]).alias("responses"))


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """``task, z, p_value`` of two runs' ``task, value, stderr``; the p-value is two-sided normal."""
    a, b = (x.select("task", F.col("value").alias(f"v{i}"), F.col("stderr").alias(f"s{i}")) for i, x in enumerate((first, second)))
    z = ratio(F.col("v0") - F.col("v1"), F.sqrt(F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1")))

    @F.pandas_udf("double")
    def p_value(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))

    return a.join(b, "task").select("task", z.alias("z")).withColumn("p_value", p_value("z"))


def win_rate(preferences: Column) -> Column:
    """Share of pairs where the second output is preferred (2), ties (0 or null) counting half."""
    return F.avg(F.when(preferences == 2, 1.0).when(preferences == 1, 0.0).otherwise(0.5))


def token_cost(df: DataFrame, by: Sequence[str], tokens: Column, price_per_1k: Mapping[str, float]) -> DataFrame:
    """``by, n_tokens, cost_<model>`` of sending the rows to priced models."""
    sums = df.groupBy(*by).agg(F.sum(tokens).alias("n_tokens"))
    return sums.select("*", *[(F.col("n_tokens") / 1000 * p).alias(f"cost_{m}") for m, p in price_per_1k.items()])


def results_table(rows: Sequence[Mapping], arrows: Mapping[str, bool] | None = None) -> str:
    """Markdown table of task, version, filter, shots, metric, value and error; values with 4 decimals, ↑ where higher is better."""
    head = ["Tasks", "Version", "Filter", "n-shot", "Metric", "", "Value", "", "Stderr"]
    lines = ["|" + "|".join(head) + "|", "|" + "|".join("---" for _ in head) + "|"]
    for r in rows:
        better = (arrows or {}).get(r["metric"])
        err = r.get("stderr")
        cells = [r["task"], r.get("version", ""), r.get("filter", "none"), r.get("n_shot", ""), r["metric"], "" if better is None else "↑" if better else "↓",
                 f"{r['value']:.4f}", "±" if err is not None else "", "N/A" if err is None else f"{err:.4f}"]
        lines.append("|" + "|".join(map(str, cells)) + "|")
    return "\n".join(lines) + "\n"


# ---- other answer metrics ---------------------------------------------------------------------------------------


def _assign(cost: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of the assignment of greatest total; Hungarian method on potentials."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if n > m:
        return [(b, a) for a, b in _assign([list(c) for c in zip(*cost)])]
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [math.inf] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], math.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    if (now := -cost[i0 - 1][j - 1] - u[i0] - v[j]) < least[j]:
                        least[j], way[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


def bag_f1(predicted: Sequence[str], gold: Sequence[str]) -> float:
    """Mean F1 of the best one-to-one alignment of two lists of answers, as sets of words; unmatched answers score 0."""
    a, b = [set(x.split()) for x in predicted], [set(x.split()) for x in gold]
    if not a or not b:
        return 0.0
    numbers = lambda s: {w for w in s if w.replace(".", "", 1).lstrip("-").isdigit()}

    def f1(x: set, y: set) -> float:
        if numbers(y) and not numbers(x) & numbers(y):
            return 0.0
        same = len(x & y)
        return 2 * same / (len(x) + len(y)) if same else float(not x and not y)

    table = [[f1(x, y) for y in b] for x in a]
    return round(sum(table[i][j] for i, j in _assign(table)) / max(len(a), len(b)), 2)


def squad_report(df: DataFrame, prediction: str, references: str, no_answer: str, threshold: float = 1.0) -> DataFrame:
    """One row: exact and F1, over all rows and over those with and without an answer; above the threshold a row answers nothing."""
    from siftloom.functions.text import answer_form, token_f1

    answered = F.when(F.col(no_answer) > threshold, F.lit("")).otherwise(F.coalesce(F.col(prediction), F.lit("")))
    has = F.size(references) > 0
    empty = (answer_form(answered) == "").cast("double")
    exact = F.when(has, best_over(F.col(references), lambda r: (answer_form(r) == answer_form(answered)).cast("double"))).otherwise(empty)
    f1 = F.when(has, best_over(F.col(references), lambda r: token_f1(answered, r))).otherwise(empty)
    rows = df.select(has.alias("has"), exact.alias("exact"), f1.alias("f1"))
    sides = {"": F.lit(True), "has_answer_": F.col("has"), "no_answer_": ~F.col("has")}
    return rows.agg(*[(100 * F.avg(F.when(s, F.col(m)))).alias(k + m) for k, s in sides.items() for m in ("exact", "f1")], F.count("*").alias("n"))


def squad_thresholds(df: DataFrame, prediction: str, references: str, no_answer: str, key: str) -> DataFrame:
    """One row: the best exact and F1 that a threshold on the no-answer probability can reach, and the thresholds.

    ``best_exact, best_exact_thresh, best_f1, best_f1_thresh``. Rows up to a threshold answer,
    the others say nothing. From saying nothing (threshold 0) rows join in order of their
    probability, ties by ``key``; the first best wins. Running totals carry it, so no task
    holds all rows.
    """
    from siftloom.functions.text import answer_form, token_f1
    from siftloom.operators.prefix import running_total

    p = F.coalesce(F.col(prediction), F.lit(""))
    has, says = F.size(references) > 0, answer_form(p) != ""
    exact = best_over(F.col(references), lambda r: (answer_form(r) == answer_form(p)).cast("double"))
    f1 = best_over(F.col(references), lambda r: token_f1(p, r))
    # What answering adds to saying nothing.
    gain = lambda m: F.when(has, m).when(says, F.lit(-1.0)).otherwise(F.lit(0.0))
    rows = df.select(key, F.col(no_answer).alias("_p"), gain(exact).alias("_e"), gain(f1).alias("_f"), (~has).cast("double").alias("_none"))
    summed = running_total(rows, [], [F.col("_p"), F.col(key)], {"exact": F.col("_e"), "f1": F.col("_f"), "place": F.lit(1)})
    whole = rows.agg(F.count("*").alias("_n"), F.sum("_none").alias("_base"))
    best = lambda c: F.max(F.struct(F.round(F.col(c), 9).alias("v"), (-F.col("place")).alias("at"), F.col("_p").alias("t")))
    top = summed.agg(best("exact").alias("e"), best("f1").alias("f")).crossJoin(F.broadcast(whole))
    value = lambda c: (100.0 * (F.col("_base") + F.greatest(F.col(c)["v"], F.lit(0.0))) / F.col("_n"))
    at = lambda c: F.when(F.col(c)["v"] > 0, F.col(c)["t"]).otherwise(F.lit(0.0))
    return top.select(value("e").alias("best_exact"), at("e").alias("best_exact_thresh"), value("f").alias("best_f1"), at("f").alias("best_f1_thresh"))


def boxed(text: Column) -> Column:
    """``boxed_answer`` of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: boxed_answer(t) if isinstance(t, str) else None)

    return run(text)


def bag_f1_of(predicted: Column, gold: Column) -> Column:
    """``bag_f1`` of two columns of arrays, in Arrow batches; null arrays count as empty."""

    @F.pandas_udf("double")
    def run(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([bag_f1([] if a is None else list(a), [] if b is None else list(b)) for a, b in zip(p, g)], dtype=float)

    return run(predicted, gold)


def boxed_answer(text: str) -> str | None:
    r"""What stands in the last ``\boxed{}`` or ``\fbox{}`` of a solution, braces balanced; null if none."""
    start = max(text.rfind("\\boxed"), text.rfind("\\fbox"))
    if start < 0:
        return None
    at = text.find("{", start)
    depth = 0
    for i in range(at, len(text)) if at >= 0 else ():
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[at + 1 : i]
    return None


# Marks without meaning in a short LaTeX answer, and other names of the same command.
_NO_MEANING = r"\\left|\\right|\\!|\\\$|\\%|%|\^\\circ|\^\{\\circ\}|\s"
_SAME = [(r"\\[td]frac", r"\\frac"), (r"\\\\", r"\\")]
_UNIT = r"\\text\{ .*$"
_NUMBER = r"(?<![\d.])\.(?=\d)"
_PART = r"(\{[^{}]*\}|\\[a-zA-Z]+|[^{}\\\s])"


def latex_form(answer: Column) -> Column:
    r"""Normal form of a short LaTeX answer.

    An answer is a number, fraction, root or text, perhaps named by one letter or two and
    followed by a unit. Units, names, spacing and size commands go; decimals begin with a
    digit; arguments of ``\frac`` and ``\sqrt`` stand in braces; a plain ratio of whole
    numbers, and a half, are written as ``\frac``. Null stays null.
    """
    out = F.regexp_replace(answer, _UNIT, "")
    for old, new in _SAME:
        out = F.regexp_replace(out, old, new.replace("\\", "\\\\") if new != r"\\" else "\\\\")
    out = F.regexp_replace(out, r"(\\frac|\\sqrt)\s+", "$1")
    out = F.regexp_replace(out, _NO_MEANING, "")
    out = F.regexp_replace(out, _NUMBER, "0.")
    out = F.regexp_replace(out, r"^[^=]{0,2}=([^=]*)$", "$1")
    braced = lambda x: F.concat(F.lit("{"), F.regexp_replace(x, r"^\{|\}$", ""), F.lit("}"))
    for command, n in (("frac", 2), ("sqrt", 1)):
        # Each command with its arguments is one piece, rewritten by itself.
        whole = rf"\\{command}" + _PART * n
        found = F.regexp_extract_all(out, F.lit(f"({whole})"), F.lit(1))
        made = F.transform(found, lambda x: F.concat(F.lit(f"\\{command}"), *[braced(F.regexp_extract(x, whole, k + 1)) for k in range(n)]))  # noqa: B023
        rest = F.split(out, whole, -1)
        out = F.array_join(F.flatten(F.zip_with(rest, made, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    out = F.regexp_replace(out, r"^(-?\d+)/(-?\d+)$", r"\\frac{$1}{$2}")
    return F.when(out == "0.5", F.lit("\\frac{1}{2}")).otherwise(out)


def latex_equal(a: Column, b: Column) -> Column:
    """Whether two LaTeX answers have the same normal form; two nulls do."""
    return latex_form(a).eqNullSafe(latex_form(b))


def rouge(prediction: Column, reference: Column, n: int = 1) -> Column:
    """ROUGE-n F1 of two texts: common n-grams of normalised words, counted as often as both have them; 0 without any."""
    from siftloom.functions.text import clean_answer, multiset_overlap, word_ngrams

    a, b = word_ngrams(clean_answer(prediction), n), word_ngrams(clean_answer(reference), n)
    same = multiset_overlap(a, b)
    return F.when(same > 0, 2.0 * same / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def reference_gap(true: Column, false: Column, metric: Callable[[Column], Column]) -> Column:
    """``best, diff, acc``: best value over the true references, its lead over the false ones, and whether it leads."""
    good, bad = best_over(true, metric), best_over(false, metric)
    return F.struct(good.alias("best"), (good - bad).alias("diff"), (good > bad).cast("double").alias("acc"))


def true_mass(scores: Column, labels: Column) -> Column:
    """Share of the probability of all options that the true ones (label 1) hold, from log likelihoods."""
    p = F.zip_with(softmax(scores), labels, lambda s, y: F.when(y == 1, s).otherwise(0.0))
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + x)


def likelihood_preference(first: Column, second: Column) -> Column:
    """``likelihood_diff, prefers_first`` of two log likelihoods of a pair of sentences."""
    return F.struct(F.abs(first - second).alias("likelihood_diff"), (first > second).cast("double").alias("prefers_first"))


def loglikelihood_rows(df: DataFrame, key: str, logprobs: str, greedy: str) -> DataFrame:
    """``key, loglikelihood, is_greedy``: the sum of the log probabilities of the answer's tokens, and whether each was the likeliest."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + x)
    return df.select(key, total.alias("loglikelihood"), F.coalesce(F.forall(greedy, lambda g: g), F.lit(False)).alias("is_greedy"))


def rolling_rows(df: DataFrame, key: str, loglikelihood: str, text: str) -> DataFrame:
    """``key, metric, loglikelihood, weight``: the rows of word and byte perplexity and bits per byte of a rolling log likelihood.

    Words are the parts between runs of white space, bytes those of UTF-8. Null texts give none.
    """
    from siftloom.functions.text import byte_count, word_count

    each = F.array(*[F.struct(F.lit(m).alias("metric"), w.cast("long").alias("weight")) for m, w in (("word_perplexity", word_count(F.col(text))), ("byte_perplexity", byte_count(F.col(text))), ("bits_per_byte", byte_count(F.col(text))))])
    return df.where(F.col(text).isNotNull()).select(key, F.col(loglikelihood).alias("loglikelihood"), F.explode(each).alias("x")).select(key, "x.metric", "loglikelihood", "x.weight")


def rolling_metrics(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, metric, value`` of ``rolling_rows``."""
    mean = ratio(F.sum("loglikelihood"), F.sum("weight"))
    value = F.when(F.col("metric") == "bits_per_byte", -F.col("m") / math.log(2)).otherwise(F.exp(-F.col("m")))
    return rows.groupBy(*by, "metric").agg(mean.alias("m")).select(*by, "metric", value.alias("value"))


def flat_accuracy(df: DataFrame, by: Sequence[str], results: str) -> DataFrame:
    """``by, n, acc``: share of true among all the checks of all documents, laid flat."""
    flat = df.select(*by, F.explode(results).alias("_ok"))
    return flat.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(F.col("_ok"), F.lit(False)).cast("double")).alias("acc"))


def reference_scores(df: DataFrame, by: Sequence[str], prediction: str, references: str) -> DataFrame:
    """``by, n, em, f1``: exact match and token F1 against the best of each document's references; none score 0."""
    from siftloom.functions.text import answer_form, token_f1

    p = F.col(prediction)
    exact = F.coalesce(best_over(F.col(references), lambda r: (answer_form(r) == answer_form(p)).cast("double")), F.lit(0.0))
    f1 = F.coalesce(best_over(F.col(references), lambda r: token_f1(p, r)), F.lit(0.0))
    return df.select(*by, exact.alias("_e"), f1.alias("_f")).groupBy(*by).agg(F.count("*").alias("n"), F.avg("_e").alias("em"), F.avg("_f").alias("f1"))


def mean_class_f1(df: DataFrame, by: Sequence[str], truth: Column, predicted: Column, classes: Sequence) -> DataFrame:
    """``by, f1``: plain mean of the F1 of each class against the rest; a class neither side has scores 0."""
    one = lambda c: F.when(F.count_if(truth == c) + F.count_if(predicted == c) > 0, 2.0 * F.count_if((truth == c) & (predicted == c)) / (F.count_if(truth == c) + F.count_if(predicted == c))).otherwise(F.lit(0.0))
    return df.groupBy(*by).agg((sum((one(c) for c in classes), F.lit(0.0)) / len(classes)).alias("f1"))


def smoothed_bleu(df: DataFrame, key: str, prediction: str, reference: str, order: int = 4) -> DataFrame:
    """``key, bleu`` (0 to 100) of each pair: counts of longer n-grams are raised by one, so short answers don't score 0."""
    from siftloom.functions.text import multiset_overlap, word_ngrams, words

    logs, sizes = F.lit(0.0), None
    for n in range(1, order + 1):
        a, b = word_ngrams(F.col(prediction), n), word_ngrams(F.col(reference), n)
        add = 1 if n > 1 else 0
        logs = logs + F.log((multiset_overlap(a, b) + add) / F.greatest(F.size(a) + add, F.lit(1)))
        sizes = F.size(a) if n == 1 else sizes
    r = F.size(words(F.col(reference)))
    penalty = F.when(sizes < r, F.exp(1 - r / F.greatest(sizes, F.lit(1)))).otherwise(F.lit(1.0))
    some = multiset_overlap(word_ngrams(F.col(prediction), 1), word_ngrams(F.col(reference), 1)) > 0
    return df.select(key, F.when(some, 100.0 * penalty * F.exp(logs / order)).otherwise(F.lit(0.0)).alias("bleu"))


def exploded_answers(df: DataFrame, key: str, answers: str) -> DataFrame:
    """``key, answer_no, answer``: each distinct answer of a document once, in order of first appearance."""
    return df.select(key, F.posexplode(F.array_distinct(answers)).alias("answer_no", "answer"))


def grouped_requests(df: DataFrame, context: Sequence[str], key: str) -> DataFrame:
    """``context, n, keys``: requests of the same context together, so that it is run once; keys in order."""
    return df.groupBy(*context).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(key)).alias("keys"))


def regression_table(first: DataFrame, second: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``task, metric, before, after, diff, verdict`` of two runs' ``task, metric, value``; what only one run has is ``added`` or ``removed``."""
    both = first.select("task", "metric", F.col("value").alias("before")).join(second.select("task", "metric", F.col("value").alias("after")), ["task", "metric"], "full_outer")
    diff = F.col("after") - F.col("before")
    verdict = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(diff > tolerance, "better").when(diff < -tolerance, "worse").otherwise("same")
    return both.select("task", "metric", "before", "after", diff.alias("diff"), verdict.alias("verdict"))


def leave_one_out(references: Column) -> Column:
    """For each reference the others; a single reference is kept."""
    return F.when(F.size(references) > 1, F.transform(references, lambda r, i: F.concat(F.slice(references, F.lit(1), i), F.slice(references, i + 2, F.size(references))))).otherwise(F.array(references))


# ---- fields of a task -------------------------------------------------------------------------------------------


#: What a template may do with a value, by name.
TEMPLATE_FILTERS: dict[str, Callable[..., Column]] = {
    "regex_replace": lambda c, old, new="": F.regexp_replace(c, old, new), "replace": lambda c, old, new: F.replace(c, F.lit(old), F.lit(new)), "trim": F.trim, "lower": F.lower, "upper": F.upper,
    "capitalize": lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30))), "length": F.length, "string": lambda c: c.cast("string"), "default": lambda c, x: F.coalesce(c, F.lit(x)),
    "join": lambda c, by="": F.array_join(c, by), "first": lambda c: F.try_element_at(c, F.lit(1)), "last": lambda c: F.try_element_at(c, F.lit(-1)),
}


def _rendered(body: str, columns: Sequence[str]) -> Column:
    """One ``{{ }}`` part: a field, an element ``field[2]`` or ``field[other]``, or a quoted text, with filters behind ``|``."""
    import ast
    import re

    value, *filters = re.split(r"""\|(?=(?:[^'"]|'[^']*'|"[^"]*")*$)""", body)
    value = value.strip()
    if m := re.fullmatch(r"([\w.]+)\[(-?\w+)\]", value):
        name, at = m.groups()
        place = F.lit(int(at)) if at.lstrip("-").isdigit() else F.col(at).cast("int")
        out = F.try_element_at(F.col(name), F.when(place >= 0, place + 1).otherwise(place))
    elif value[:1] in "'\"":
        name, out = None, F.lit(ast.literal_eval(value))
    else:
        name, out = value, F.col(value)
    if name is not None and name.split(".")[0] not in columns:
        raise ValueError(f"unknown field {name!r}")
    for f in filters:
        m = re.fullmatch(r"\s*(\w+)\s*(\(.*\))?\s*", f, re.S)
        if not m or m[1] not in TEMPLATE_FILTERS:
            raise ValueError(f"unknown filter {f!r}")
        args = ast.literal_eval(f"({m[2][1:-1]},)") if m[2] and m[2] != "()" else ()
        out = TEMPLATE_FILTERS[m[1]](out, *args)
    return out


def resolve(spec, columns: Sequence[str]) -> Column:
    """The value a task names: a Column builder, number, column, ``{{field}}`` template, list, or text.

    Digit strings become numbers and ``[..]`` literals arrays. Nothing in a spec is run as code.
    """
    if callable(spec):
        return spec()
    if isinstance(spec, (list, tuple)):
        return F.array(*[resolve(s, columns) for s in spec])
    if not isinstance(spec, str):
        return F.lit(spec)
    if spec in columns:
        return F.col(spec)
    if "{{" in spec:
        parts, rest = [], spec
        while "{{" in rest:
            head, _, rest = rest.partition("{{")
            name, closed, rest = rest.partition("}}")
            if not closed:
                raise ValueError(f"open field in {spec!r}")
            parts += [F.lit(head), F.coalesce(_rendered(name, columns).cast("string"), F.lit(""))]
        return F.concat(*parts, F.lit(rest))
    if spec.isdigit():
        return F.lit(int(spec))
    if spec.startswith("[") and spec.endswith("]"):
        import ast

        return F.array(*[F.lit(x) for x in ast.literal_eval(spec)])
    return F.lit(spec)


def fewshot_context(description: Column, examples: Column, question: Column, joiner: str = "\n\n") -> Column:
    """Description, examples (array of ``shot, text``) in order of their shot, and the question."""
    shots = F.transform(F.sort_array(F.coalesce(examples, F.array().cast("array<struct<shot: int, text: string>>"))), lambda e: e["text"])
    return F.concat(F.coalesce(description, F.lit("")), F.array_join(F.concat(shots, F.array(question)), joiner))


# ---- instructions that can be checked ---------------------------------------------------------------------------

CHECKS: dict[str, Callable[..., Column]] = {
    "no_comma": lambda r: ~F.contains(r, F.lit(",")),
    "all_lower": lambda r: (r == F.lower(r)) & r.rlike("[a-z]"),
    "all_upper": lambda r: (r == F.upper(r)) & r.rlike("[A-Z]"),
    "min_words": lambda r, n: F.size(F.regexp_extract_all(r, F.lit(r"\w+"), F.lit(0))) >= n,
    "max_words": lambda r, n: F.size(F.regexp_extract_all(r, F.lit(r"\w+"), F.lit(0))) < n,
    "keywords": lambda r, *words: sum((F.lower(r).contains(w.lower()).cast("int") for w in words), F.lit(0)) == len(words),
    "forbidden": lambda r, *words: ~F.lower(r).rlike("|".join(rf"\b\Q{w.lower()}\E\b" for w in words)),
    "paragraphs": lambda r, n: F.size(F.filter(F.split(r, r"\s?\*\*\*\s?"), lambda p: F.trim(p) != "")) == n,
    "placeholders": lambda r, n: F.size(F.regexp_extract_all(r, F.lit(r"\[.*?\]"), F.lit(0))) >= n,
    "bullets": lambda r, n: F.size(F.regexp_extract_all(r, F.lit(r"(?m)^\s*\*[^\*].*$|^\s*-.*$"), F.lit(0))) == n,
    "starts_with": lambda r, s: F.startswith(F.lower(F.trim(r)), F.lit(s.lower())),
    "ends_with": lambda r, s: F.endswith(F.lower(F.trim(F.regexp_replace(F.trim(r), '^"|"$', ""))), F.lit(s.lower())),
    "quoted": lambda r: (F.length(F.trim(r)) > 1) & F.startswith(F.trim(r), F.lit('"')) & F.endswith(F.trim(r), F.lit('"')),
    "json": lambda r: F.try_parse_json(F.regexp_replace(F.trim(r), r"^```(?:json|JSON|Json)?\s*|\s*```$", "")).isNotNull(),
    "keyword_times": lambda r, word, n, least=True: (F.size(F.regexp_extract_all(F.lower(r), F.lit(rf"\Q{word.lower()}\E"), F.lit(0))) >= n) == F.lit(least),
    "letter_times": lambda r, letter, n, least=True: (F.length(r) - F.length(F.translate(F.lower(r), letter.lower(), "")) >= n) == F.lit(least),
    "sentences": lambda r, n, least=True: (F.size(F.regexp_extract_all(r, F.lit(r"[^.!?]*[.!?]+(?=\s|$)|[^.!?]+$"), F.lit(0))) >= n) == F.lit(least),
    "highlights": lambda r, n: F.size(F.filter(F.regexp_extract_all(r, F.lit(r"\*{1,2}([^\n*]*)\*{1,2}"), F.lit(1)), lambda x: F.trim(x) != "")) >= n,
    "sections": lambda r, name, n: F.size(F.split(r, rf"\s?\Q{name}\E\s?\d+\s?")) > n,
    "postscript": lambda r, mark: F.lower(r).rlike({"P.P.S": r"p\.\s?p\.\s?s", "P.S.": r"p\.\s?s\."}.get(mark, rf"\Q{mark.lower()}\E")),
    "two_responses": lambda r: (F.size(F.filter(F.split(r, r"\*{6}"), lambda p: F.trim(p) != "")) == 2) & (F.size(F.array_distinct(F.transform(F.filter(F.split(r, r"\*{6}"), lambda p: F.trim(p) != ""), F.trim))) == 2),
    "repeats_prompt": lambda r, prompt: F.startswith(F.lower(F.trim(r)), F.lower(F.trim(prompt if isinstance(prompt, Column) else F.lit(prompt)))),
    "one_of": lambda r, *options: F.exists(F.array(*map(F.lit, options)), lambda o: F.contains(F.trim(r), o)),
    "paragraph_starts": lambda r, n, k, word: (F.size(F.filter(F.split(r, r"\n\n"), lambda p: F.trim(p) != "")) == n) & F.coalesce(F.lower(F.regexp_extract(F.try_element_at(F.split(r, r"\n\n"), F.lit(k)), r"^\W*(\w+)", 1)) == word.lower(), F.lit(False)),
    "capital_words": lambda r, n, least=True: (F.size(F.regexp_extract_all(r, F.lit(r"\b[A-Z]+\b"), F.lit(0))) >= n) == F.lit(least),
    "title": lambda r: r.rlike(r"<<[^\n]*[^\s<>][^\n]*>>"),
}


def loose_variants(response: Column) -> Column:
    """The response as it is, without stars, and each without first, last, or first and last line: 8 in all."""
    lines = F.split(response, "\n")
    n = F.size(lines)
    cut = lambda a, b: F.trim(F.array_join(F.slice(lines, F.lit(1 + a), F.greatest(n - a - b, F.lit(0))), "\n"))
    four = [response, cut(1, 0), cut(0, 1), cut(1, 1)]
    return F.array(*four, *[F.replace(x, F.lit("*"), F.lit("")) for x in four])


def follows(response: Column, checks: Sequence[tuple], loose: bool = False) -> Column:
    """Array of booleans, one a check: whether the response (loose: any of its variants) is not blank and passes."""
    one = lambda r, name, *args: F.coalesce((F.trim(r) != "") & CHECKS[name](r, *args), F.lit(False))
    if loose:
        passes = lambda c: lambda r: one(r, *c)
        return F.array(*[F.exists(loose_variants(response), passes(c)) for c in checks])
    return F.array(*[one(response, *c) for c in checks])
