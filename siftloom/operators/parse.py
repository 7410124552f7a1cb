"""Requests to a rater, and its answers turned into typed ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftloom.functions.labels import DOMAINS, METRICS
from siftloom.functions.text import clean_text, right_split, template

# The patterns of scores, categories and "N/A" in answers, per language.
SCORE = {
    "en": r"(?:\[[1-9][0-4]?\]|\b[1-9][0-4]?\.|\b[1-9][0-4]?\)).*(?:\*+|\s+|\(+)(\d+(\.\d+)?)/5",
    "zh": r"\[[1-9][0-4]?\][^：]+：(\d+(?:\.\d+)?)/5",
}
CATEGORY = {
    "en": [r"\[\s*([A-Z])\s*\]", r"(?<=\s)([A-Z])(?=\])(?!\]\])", r"\bDomain Type:\**\s*\**([A-Z])\s*(?=[\(\)\*\-])"],
    "zh": [r"领域类型.*?[\[\]]?([A-Z])[\]\[]?"],
}
NOT_GIVEN = {"en": r"(?:\*\s|:\s)N/A", "zh": r"：N/A"}
#: The order in which failures are told; a row has the first that holds.
FAILURES = ["api_failure", "na_present", "no_scores", "too_few", "too_many", "conflicting", "no_category", "several_categories"]


def scores(answer: Column, lang: str) -> Column:
    """All scores of an answer in order, as doubles (whole numbers, not their first digit)."""
    return F.transform(F.regexp_extract_all(answer, F.lit(SCORE[lang]), F.lit(1)), lambda s: s.cast("double"))


def categories(answer: Column, lang: str) -> Column:
    """Distinct category letters of an answer, in order of first appearance within each pattern."""
    found = F.concat(*[F.regexp_extract_all(answer, F.lit(p), F.lit(1)) for p in CATEGORY[lang]])
    return F.array_distinct(F.filter(found, lambda c: c != ""))


def accept(responses: DataFrame, lang: str, status: str = "status", answer: str = "answer") -> DataFrame:
    """Adds ``outcome`` (``ok`` or the first failure), ``scores`` (14, for ok rows) and ``category``.

    28 scores with equal halves count as 14. A null answer of a successful call has no scores.
    """
    text = F.coalesce(F.col(answer), F.lit(""))
    s, c = F.col("_s"), F.col("_c")
    half = F.size(s) == 28
    first, second = F.slice(s, 1, 14), F.slice(s, 15, 14)
    outcome = (
        F.when(~F.coalesce(F.col(status) == "success", F.lit(False)), FAILURES[0])
        .when(text.rlike(NOT_GIVEN[lang]), FAILURES[1])
        .when(F.size(s) == 0, FAILURES[2])
        .when(F.size(s) < 14, FAILURES[3])
        .when((F.size(s) > 14) & ~half, FAILURES[4])
        .when(half & (first != second), FAILURES[5])
        .when(F.size(c) == 0, FAILURES[6])
        .when(F.size(c) > 1, FAILURES[7])
        .otherwise("ok")
    )
    parsed = responses.withColumn("_s", scores(text, lang)).withColumn("_c", categories(text, lang)).withColumn("outcome", outcome)
    ok = F.col("outcome") == "ok"
    return parsed.withColumn("scores", F.when(ok, first)).withColumn("category", F.when(ok, F.element_at(c, 1))).drop("_s", "_c")


def rounded(score: Column) -> Column:
    """Whole score: down under 3, up from 3."""
    return F.when(score < 3, F.floor(score)).otherwise(F.ceil(score)).cast("int")


def typed_ratings(accepted: DataFrame) -> DataFrame:
    """One column for each of the 14 metrics (rounded) and the domain name, from accepted rows."""
    ok = accepted.where("outcome = 'ok'")
    return ok.select("*", *[rounded(F.col("scores")[i]).alias(m) for i, m in enumerate(METRICS)])


def target_text(category: Column, values: Column) -> Column:
    """Category and 14 scores, one a line: what a rater is trained to answer."""
    return F.concat_ws("\n", category, F.transform(values, lambda v: rounded(v).cast("string")))


def original_text(request: Column, lang: str) -> Column:
    """The text inside a request; null if the request does not have the form."""
    pattern = {"en": r"(?s)\nText: (.*?)(\n)+(?:Domain Types|Overall Score)", "zh": r"(?s)\n文本：(.*?)(\n)+(?:领域类型|总评)"}[lang]
    return F.when(request.rlike(pattern), F.regexp_extract(request, pattern, 1))


def build_requests(docs: DataFrame, index: str, text: str, pattern: str, model: str, temperature: float = 0.0, max_tokens: int = 1024) -> DataFrame:
    """``index, request_json`` of each document with the cleaned text filled into the pattern's ``{text}``."""
    content = template(pattern, text=clean_text(F.col(text)))
    message = F.struct(F.lit("user").alias("role"), content.alias("content"))
    request = F.struct(F.lit(model).alias("model"), F.array(message).alias("messages"), F.lit(float(temperature)).alias("temperature"), F.lit(max_tokens).alias("max_tokens"))
    return docs.select(F.col(index).alias("index"), request.alias("request_json"))


def build_sample(docs: DataFrame, index: str, request: Column, response: Column, form: str = "qwen2") -> DataFrame:
    """Training rows: ``qwen2`` as type, messages and source; ``qwen`` as id and conversations."""
    source = right_split(F.col(index))[0]
    turn = lambda role, content, a="role", b="content": F.struct(F.lit(role).alias(a), content.alias(b))
    if form == "qwen2":
        return docs.select(F.lit("chatml").alias("type"), F.array(turn("user", request), turn("assistant", response)).alias("messages"), source.alias("source"))
    if form == "qwen":
        return docs.select(F.col(index).alias("id"), F.array(turn("user", request, "from", "value"), turn("assistant", response, "from", "value")).alias("conversations"), source.alias("source"))
    raise ValueError(f"unknown form {form!r}")


def detail_text(responses: DataFrame, index: str, documents: DataFrame, document_index: str, text: str) -> DataFrame:
    """Responses with the full text of the line their id names, joined on source and number."""
    a = [p.alias(f"_{n}") for n, p in zip("sn", right_split(F.col(index)))]
    b = [p.alias(f"_{n}") for n, p in zip("sn", right_split(F.col(document_index)))]
    return responses.select("*", *a).join(documents.select(*b, F.col(text).alias("full_text")), ["_s", "_n"]).drop("_s", "_n")


def exclude_existing(rows: DataFrame, index: str, existing: DataFrame, existing_index: str) -> DataFrame:
    """Rows whose source and number are not among the existing ones."""
    a = [p.alias(f"_{n}") for n, p in zip("sn", right_split(F.col(index)))]
    b = [p.alias(f"_{n}") for n, p in zip("sn", right_split(F.col(existing_index)))]
    return rows.select("*", *a).join(existing.select(*b).distinct(), ["_s", "_n"], "left_anti").drop("_s", "_n")


def domain_name(letter: Column, lang: str = "en") -> Column:
    """Name of a domain letter; null if it is none."""
    names = {k: both[lang == "zh"] for k, both in DOMAINS.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), letter)


def parse_model_output(df: DataFrame, output: str, drop_malformed: bool = True) -> DataFrame:
    """Domain letter and 14 ratings from a model's 15 lines; malformed outputs are dropped or get nulls."""
    lines = F.split(F.trim(F.col(output)), "\n")
    whole = F.size(lines) == 15
    out = df.where(F.coalesce(whole, F.lit(False))) if drop_malformed else df
    return out.withColumn("application_domain", F.when(whole, F.trim(lines[0]))).withColumns({m: F.when(whole, F.trim(lines[i + 1])) for i, m in enumerate(METRICS)})
