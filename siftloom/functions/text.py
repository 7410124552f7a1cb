"""Text functions: cleaning, counting, n-grams, normal forms of answers. Columns in, columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A leading quoted ellipsis; image links without a caption.
ELLIPSIS = r'^["“”](?:…+|\.\.\.+)["“”]'
IMAGE = r"!\[\]\([\/]?[^\)]+\)\n"
# The ASCII tables of the n-gram normal form.
UPPER, LOWER, PUNCTUATION = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def clean_text(text: Column) -> Column:
    """Without a leading quoted ellipsis and without captionless image links."""
    return F.regexp_replace(F.regexp_replace(text, ELLIPSIS, ""), IMAGE, "")


def word_count(text: Column) -> Column:
    """Parts between runs of white space, empty edge parts counted; 0 only for null."""
    return F.coalesce(F.size(F.split(text, r"\s+")), F.lit(0))


def trimmed_word_count(text: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0))


def byte_count(text: Column) -> Column:
    return F.octet_length(text)


def ngram_form(text: Column) -> Column:
    """Lower case and without punctuation, by ASCII tables only."""
    return F.translate(text, UPPER + PUNCTUATION, LOWER)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` for an array-valued ``use``, with ``value`` evaluated once."""
    return F.flatten(F.transform(F.array(value), use))


def words(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_ngrams(text: Column, n: int) -> Column:
    """Runs of ``n`` words joined by a blank; none for a shorter or null text."""
    grams = lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(bound(words(text), grams), F.array().cast("array<string>"))


def ngrams(items: Column, n: int) -> Column:
    """Runs of ``n`` elements of an array, as arrays."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.size(items) - (n - 1)), lambda i: F.slice(items, i, n)))


def truncate_middle(tokens: Column, most: int, marker: str | None = "...") -> Column:
    """Head ``most // 2`` and tail ``ceil(most / 2)`` tokens with a marker between; shorter arrays stay as they are."""
    head, tail = most // 2, -(-most // 2)
    parts = [F.slice(tokens, 1, head)] + ([F.array(F.lit(marker))] if marker is not None else []) + [F.slice(tokens, F.size(tokens) - (tail - 1), tail)]
    return F.when(F.size(tokens) > most, F.concat(*parts)).otherwise(tokens)


def truncate_chars(text: Column, most: int) -> Column:
    """Head ``most // 2`` and tail ``ceil(most / 2)`` characters of a longer text."""
    head, tail = most // 2, -(-most // 2)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, head), F.right(text, F.lit(tail)))).otherwise(text)


def truncate_keep(tokens: Column, most: int, keep: int) -> Column:
    """Head ``keep`` and tail ``keep`` tokens of an array longer than ``most``."""
    return F.when(F.size(tokens) > most, F.concat(F.slice(tokens, 1, keep), F.slice(tokens, F.size(tokens) - (keep - 1), keep))).otherwise(tokens)


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


# Detokenizers, as plain replacements and then patterns.
GENERAL = [(" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"')]
WIKITEXT_PLAIN = [
    ("s '", "s'"), (" @-@ ", "-"), (" @,@ ", ","), (" @.@ ", "."), (" : ", ": "), (" ; ", "; "), (" . ", ". "), (" ! ", "! "), (" ? ", "? "), (" , ", ", "),
]
WIKITEXT_PATTERNS = [
    (r"/' [0-9]/", r"/'[0-9]/"), (r"\(\s*([^\)]*?)\s*\)", "($1)"), (r"\[\s*([^\]]*?)\s*\]", "[$1]"), (r"\{\s*([^\}]*?)\s*\}", "{$1}"),
    ('"\\s*([^"]*?)\\s*"', '"$1"'), (r"'\s*([^']*?)\s*'", "'$1'"),
]
WIKITEXT_LAST = [("= = = =", "===="), ("= = =", "==="), ("= =", "=="), (" " + chr(176) + " ", chr(176)), (" \n", "\n"), ("\n ", "\n"), (" N ", " 1 "), (" 's", "'s")]

TITLE = [(" [title]", ". ")]
DIALOGUE = [(" '", "'"), (" \n", "\n"), ("\n ", "\n"), (" n't", "n't"), ("`` ", '"'), ("''", '"'), (" :", ":"), (" ;", ";"), (" !", "!"), (" ?", "?"), (" ,", ","), (" .", ".")]


def general_detokenize(text: Column) -> Column:
    return F.regexp_replace(replaced(text, GENERAL), r" (['.,])", "$1")


def wikitext_detokenize(text: Column) -> Column:
    out = replaced(text, WIKITEXT_PLAIN)
    for pattern, new in WIKITEXT_PATTERNS:
        out = F.regexp_replace(out, pattern, new)
    return replaced(out, WIKITEXT_LAST)


def hellaswag_detokenize(text: Column) -> Column:
    out = replaced(F.trim(text), TITLE)
    return F.replace(F.regexp_replace(out, r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def dialogue_detokenize(text: Column) -> Column:
    return replaced(text, DIALOGUE)


def answer_form(text: Column) -> Column:
    """Lower case, without ASCII punctuation and English articles, blanks squeezed."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def number_aware_form(text: Column) -> Column:
    """As ``answer_form`` word by word, keeping the marks of numbers and writing them as decimals."""
    parts = F.split(F.regexp_replace(F.lower(text), "-", " "), r"\s+")
    one = lambda w: F.when(w.rlike(r"^[-+]?\d*\.?\d+$"), w.cast("double").cast("string")).otherwise(answer_form(w))
    return F.array_join(F.filter(F.transform(parts, one), lambda w: w != ""), " ")


def clean_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation and line breaks, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), PUNCTUATION, ""), r"\n+", " "))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Common elements of two arrays, counted as often as both have them; nulls don't count.

    Both arrays are sorted together, and one pass with a state of fixed size takes for each
    element of the second one of the same kind that the first has left.
    """
    marked = lambda x, tag: F.transform(F.filter(x, lambda w: w.isNotNull()), lambda w: F.struct(w.alias("w"), F.lit(tag).alias("tag")))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("left"), F.lit(0).alias("same"))

    def step(s: Column, x: Column) -> Column:
        left = F.when(s["last"].eqNullSafe(x["w"]), s["left"]).otherwise(F.lit(0))
        taken = ((x["tag"] == 1) & (left > 0)).cast("int")
        return F.struct(x["w"].alias("last"), (left + F.when(x["tag"] == 0, 1).otherwise(0) - taken).alias("left"), (s["same"] + taken).alias("same"))

    return F.aggregate(F.array_sort(F.concat(marked(a, 0), marked(b, 1))), start, step)["same"]


def token_f1(prediction: Column, truth: Column) -> Column:
    """F1 of the normalised tokens as multisets; 0 without overlap or where either has none."""
    a, b = words(answer_form(prediction)), words(answer_form(truth))
    same = multiset_overlap(a, b)
    return F.when(same > 0, 2.0 * same / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def softmax(scores: Column) -> Column:
    """Softmax of an array of doubles."""
    top = F.array_max(scores)
    whole = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(scores, lambda x: F.exp(x - top) / whole)


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def escaped_split(text: Column, separator: str) -> Column:
    """Split at separators that no backslash precedes."""
    return F.split(text, rf"(?<!\\)\Q{separator}\E")


def sanitized(name: Column) -> Column:
    """File-safe model name: quotes, marks and blanks become underscores."""
    return F.regexp_replace(name, r'["<>:/\|\\?\*\[\]]+', "__")


def right_split(document_index: Column) -> tuple[Column, Column]:
    """(source, number) of an id, split at the last underscore."""
    return F.regexp_extract(document_index, r"^(.*)_([^_]*)$", 1), F.regexp_extract(document_index, r"^(.*)_([^_]*)$", 2)


def stable_bucket(value: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(n))


def template(pattern: str, **columns: Column) -> Column:
    """``{name}`` parts of the pattern filled with columns; texts are never read as patterns. A null part is blank."""
    out, rest = [], pattern
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(head), F.coalesce(columns[name].cast("string"), F.lit(""))]
    return F.concat(*out, F.lit(rest))


def instruction_prompt(instruction: Column, input_: Column, with_input: str, without_input: str) -> Column:
    """The prompt with or without an input part; an empty or null input counts as none."""
    empty = F.coalesce(F.length(input_) == 0, F.lit(True))
    return F.when(empty, template(without_input, instruction=instruction)).otherwise(template(with_input, instruction=instruction, input=input_))


def emotion_scale(difference: Column) -> Column:
    """Scaled difference of two emotion scores: 0 stays 0, up to 5 a sigmoid, above as it is."""
    return F.when(difference == 0, F.lit(0.0)).when(difference <= 5, 6.5 / (1 + F.exp(-1.2 * (difference - 4)))).otherwise(difference)
