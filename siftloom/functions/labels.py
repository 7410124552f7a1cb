"""Canonical forms of source, language and domain labels, and of rating strings.

Every function maps Column to Column and stays inside codegen. ``*_sql`` gives
the same expression for DuckDB, used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The domain letters with their English and Chinese names.
DOMAINS = {
    "A": ("Medicine", "医疗"), "B": ("Finance", "金融"), "C": ("Law", "法律"), "D": ("Education", "教育"),
    "E": ("Technology", "科技"), "F": ("Entertainment", "娱乐"), "G": ("Mathematics", "数学"), "H": ("Coding", "代码"),
    "I": ("Government", "政务"), "J": ("Culture", "文化"), "K": ("Transportation", "交通"),
    "L": ("Retail E-commerce", "零售电商"), "M": ("Telecommunication", "电信"), "N": ("Agriculture", "农业"),
    "O": ("Other", "其他"),
}
# The 13 criteria in order, then the overall score.
CRITERIA = [
    "accuracy", "coherence", "language_consistency", "semantic_density", "knowledge_novelty", "topic_focus", "creativity",
    "professionalism", "style_consistency", "grammatical_diversity", "structural_standardization", "originality", "sensitivity",
]
METRICS = [*CRITERIA, "overall_score"]
# Spellings of the set names whose capitals matter.
SET_NAMES = ["CommonCrawl", "C4", "GitHub", "Book", "ArXiv", "Wikipedia", "StackExchange"]
# Other names of the two languages of the data.
LANG_NAMES = {"english": "en", "eng": "en", "chinese": "zh", "zho": "zh", "chi": "zh", "cn": "zh"}

_EDGE = r"^\s+|\s+$"
_PATH = r"^.*[/\\]"
_EXT = r"\.(jsonl|json|tsv|csv|txt|parquet|arrow)(\.(zst|gz))?$"
_SET = r"^redpajama"
_LETTER = r"(?i)^(?:domain(?: type)?\s*:\s*)?\[?\s*([A-O])\s*\]?$"


def _lookup(key: Column, pairs: dict[str, str], default: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.element_at(table, key), default)


def canonical_source(source: Column) -> Column:
    """Source name without blanks, folder, file extension, set prefix and odd capitals; blank and null give null."""
    key = F.regexp_replace(source, _EDGE, "")
    for pattern in (_PATH, _EXT, _SET):
        key = F.regexp_replace(F.lower(key), pattern, "")
    return _lookup(key, {x.lower(): x for x in SET_NAMES}, F.when(key != "", key))


def source_of_id(document_index: Column) -> Column:
    """The source in an id ``<source>_<line>``, split from the right; null if there is none."""
    source = F.regexp_extract(document_index, r"^(.*)_[^_]*$", 1)
    return F.when(source != "", source)


def line_of_id(document_index: Column) -> Column:
    """The line number in an id ``<source>_<line>``; null if it is not a number."""
    return F.try_to_number(F.regexp_extract(document_index, r"_([0-9]{1,18})$", 1), F.lit("999999999999999999")).cast("long")


def canonical_lang(lang: Column) -> Column:
    """Lower-case language without region (``zh-CN`` is ``zh``); blank and null give ``und``."""
    key = F.regexp_replace(F.lower(F.regexp_replace(lang, _EDGE, "")), r"[-_].*$", "")
    return F.coalesce(_lookup(key, LANG_NAMES, F.when(key != "", key)), F.lit("und"))


def canonical_domain(domain: Column) -> Column:
    """Domain letter A to O from a letter, bracketed letter, prefixed letter or name; anything else gives ``unknown``."""
    bare = F.regexp_replace(domain, _EDGE, "")
    letter = F.upper(F.regexp_extract(bare, _LETTER, 1))
    names = {n.lower(): k for k, both in DOMAINS.items() for n in both}
    return F.coalesce(F.when(letter != "", letter), _lookup(F.lower(bare), names, F.lit("unknown")), F.lit("unknown"))


def valid_rating(rating: Column) -> Column:
    """True for a string of ASCII digits whose value is 1 to 5; null, blank and all else is false."""
    return F.coalesce(rating.rlike(r"^0*[1-5]$"), F.lit(False))


def rating(col: Column) -> Column:
    """The rating as INT where it is valid, else null."""
    return F.when(valid_rating(col), col.cast("int"))


def _map_sql(key: str, pairs: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {default} END"


def canonical_source_sql(source: str) -> str:
    key = f"regexp_replace({source}, '{_EDGE}', '', 'g')"
    for pattern in (_PATH, _EXT, _SET):
        key = f"regexp_replace(lower({key}), '{pattern}', '')"
    return _map_sql(key, {x.lower(): x for x in SET_NAMES}, f"nullif({key}, '')")


def source_of_id_sql(document_index: str) -> str:
    return f"nullif(regexp_extract({document_index}, '^(.*)_[^_]*$', 1), '')"


def canonical_lang_sql(lang: str) -> str:
    key = f"regexp_replace(lower(regexp_replace({lang}, '{_EDGE}', '', 'g')), '[-_].*$', '')"
    return f"coalesce({_map_sql(key, LANG_NAMES, f"nullif({key}, '')")}, 'und')"


def canonical_domain_sql(domain: str) -> str:
    bare = f"regexp_replace({domain}, '{_EDGE}', '', 'g')"
    names = {n.lower(): k for k, both in DOMAINS.items() for n in both}
    letter = f"upper(regexp_extract({bare}, '{_LETTER}', 1))"
    return f"coalesce(nullif({letter}, ''), {_map_sql(f'lower({bare})', names, "'unknown'")}, 'unknown')"


def rating_sql(col: str) -> str:
    return f"CASE WHEN regexp_matches({col}, '^0*[1-5]$') THEN CAST({col} AS INTEGER) END"
