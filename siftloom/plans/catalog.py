"""All registered queries of the core, with the SQL each is checked against."""

from __future__ import annotations

from . import analysis, evaluation, metrics, selection, storage, supervision, texts  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
