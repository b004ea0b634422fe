"""Substring search.

``<field> LIKE '%term%'`` with at most 50 rows.  The source system leaves the
order of the 50 undefined; we order by id so results repeat.  '%' and '_' in a
term stay wildcards (the source system does not escape them).

Case-sensitive search (``LIKE``) is pushed into the parquet scan as
``StringContains``; case-insensitive search (``ILIKE``, the default) filters
right after the scan.  With ``by`` (e.g. tenant) the top rows are taken per
group by a window whose limit Spark applies map-side (WindowGroupLimit), so
even a tenant holding a third of the rows never ships more than ``limit`` rows
per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.functions.exprs import escape_like_literal


def clean_term_value(term: str | None, trim: bool = True) -> str:
    """F3 for a constant term: NULL -> '', optionally trimmed."""
    t = "" if term is None else str(term)
    return t.strip() if trim else t


def term_ok(term: str | None, min_length: int = 2) -> bool:
    """the UI asks for at least two characters after trimming."""
    return len(clean_term_value(term)) >= min_length


def term_ok_col(term: Column, min_length: int = 2) -> Column:
    return F.char_length(F.trim(F.coalesce(term, F.lit("")))) >= min_length


def match(field: Column, term: str, case_sensitive: bool = False) -> Column:
    pattern = escape_like_literal(term)
    return field.like(pattern) if case_sensitive else field.ilike(pattern)


def search(df: DataFrame, field: str, term: str | None, limit: int = S.SEARCH_LIMIT, *,
           order_by: str | list[str] = "Id", by: list[str] | None = None, where: Column | None = None,
           case_sensitive: bool = False, trim: bool = True, min_length: int = 0) -> DataFrame:
    """Rows whose ``field`` contains ``term``, at most ``limit``
    (per ``by`` group when given), ordered by ``order_by``.

    ``where`` adds a conjunct (F2, e.g. Type = 'Service'); ``trim`` selects the
    defaults-route clean-up (True) or the mapping-route one (False);
    ``min_length`` > 0 applies the UI's minimum term length (F4): a shorter
    term returns nothing.
    """
    t = clean_term_value(term, trim)
    if min_length and len(t.strip()) < min_length:
        return df.limit(0)
    cond = match(F.col(field), t, case_sensitive)
    if where is not None:
        cond = cond & where
    hits = df.where(cond)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if not by:
        return hits.orderBy(*order).limit(limit)
    w = Window.partitionBy(*by).orderBy(*order)
    return hits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")
