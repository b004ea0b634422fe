"""Column expressions shared by the operators.  All are built-in Spark
functions, so they stay inside whole-stage codegen.

Two null idioms of the source system are kept apart on purpose:

* ``nz(a, b)``           -- ``a ?? b``: only NULL falls through.
* ``first_truthy(a, b)`` -- ``a || b``: NULL and '' fall through; the last
  argument is returned as is, even if it is '' or NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(*cols) -> Column:
    """``a ?? b ?? ...``: first non-NULL.  Columns pass through, plain Python
    values become literals."""
    return F.coalesce(*[c if isinstance(c, Column) else F.lit(c) for c in cols])


def blank_to_null(c: ColumnOrName) -> Column:
    return F.nullif(_c(c), F.lit(""))


def first_truthy(*cols) -> Column:
    """``a || b || ...`` for strings: skip NULL and ''; last one returned as is."""
    parts = [c if isinstance(c, Column) else F.lit(c) for c in cols]
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts[:-1]], parts[-1])


def nonblank(c: ColumnOrName) -> Column:
    c = _c(c)
    return c.isNotNull() & (c != F.lit(""))


def join_truthy(sep: str, *cols: Column) -> Column:
    """``[a, b, ...].filter(Boolean).join(sep)``: NULL and '' parts are skipped;
    nothing left gives ''."""
    return F.concat_ws(sep, *[F.nullif(c, F.lit("")) for c in cols])


def short_address(addr: ColumnOrName) -> Column:
    """Line1, City, CountrySubDivisionCode joined by ', '; NULL struct gives ''."""
    a = _c(addr)
    return join_truthy(", ", a["Line1"], a["City"], a["CountrySubDivisionCode"])


def long_address(addr: ColumnOrName) -> Column:
    """Line1, Line2, 'City, Region', PostalCode, Country; NULL struct gives
    'Address unavailable' (an empty struct gives '')."""
    a = _c(addr)
    city_region = join_truthy(", ", a["City"], a["CountrySubDivisionCode"])
    body = join_truthy(", ", a["Line1"], a["Line2"], city_region, a["PostalCode"], a["Country"])
    return F.when(a.isNull(), F.lit("Address unavailable")).otherwise(body)


# A JavaScript decimal literal as Number() accepts it (hex/binary not supported).
_NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_TRIM_RE = r"^\s+|\s+$"


def parse_number(c: ColumnOrName, blank_as_zero: bool = False) -> Column:
    """Lenient number parse: unparsable or non-finite gives NULL.

    Spark's cast also takes 'NaN', 'Infinity', '1d' and '1f'; the literal
    pattern rejects those first.  ``blank_as_zero`` makes '' and NULL parse as 0
    (what a present-but-empty value does in the source system); by default they
    give NULL (an absent value).
    """
    s = F.regexp_replace(_c(c).cast("string"), _TRIM_RE, "")
    num = F.when(s.rlike(_NUMBER_RE), s.try_cast("double"))
    finite = num.isNotNull() & ~F.isnan(num) & (F.abs(num) != F.lit(float("inf")))
    out = F.when(finite, num)
    if blank_as_zero:
        out = F.when(_c(c).isNull() | (s == F.lit("")), F.lit(0.0)).otherwise(out)
    return out


def utc_date(ts_text: ColumnOrName) -> Column:
    """Calendar date in UTC of an ISO-8601 timestamp with offset (the offset
    is honoured; with the session pinned to UTC the date is the UTC date)."""
    return F.to_date(F.to_timestamp(_c(ts_text)))


def clean_term(c: ColumnOrName, trim: bool = True) -> Column:
    """Search term clean-up: NULL gives '', optionally trimmed."""
    t = F.coalesce(_c(c).cast("string"), F.lit(""))
    return F.trim(t) if trim else t


def like_contains_pattern(term: ColumnOrName) -> Column:
    """'%term%' for LIKE.  '%' and '_' in the term stay wildcards (as in the
    source system); a backslash is escaped so it matches itself."""
    t = F.replace(_c(term), F.lit("\\"), F.lit("\\\\"))
    return F.concat(F.lit("%"), t, F.lit("%"))


def escape_like_literal(term: str) -> str:
    """Python-side twin of like_contains_pattern for a constant term."""
    return "%" + term.replace("\\", "\\\\") + "%"


def aes_key(secret: ColumnOrName) -> Column:
    """16-byte AES key derived from any secret string (MD5 digest)."""
    return F.unhex(F.md5(_c(secret).cast("string")))


def encrypt(c: ColumnOrName, key: Column, mode: str = "GCM") -> Column:
    return F.aes_encrypt(_c(c).cast("binary"), key, F.lit(mode))


def decrypt(c: ColumnOrName, key: Column, mode: str = "GCM") -> Column:
    return F.aes_decrypt(_c(c), key, F.lit(mode))
