"""Property tests: lenient number parsing (P14) against a Python model of
JavaScript's Number() + isFinite for decimal literals, and LIKE '%term%'
search (F1) against a regular-expression model.  Each property runs as one
Spark job over all generated examples."""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.functions.exprs import parse_number
from tallyspark.operators.search import match

_DEC = re.compile(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def js_number(s):
    """Number(s) for strings, restricted to what P14 supports (no hex/binary);
    None for NaN / non-finite (the isFinite test)."""
    if s is None:
        return None
    t = s.strip(" \t\n\r\x0b\x0c")
    if t == "":
        return None  # blank_as_zero=False: treated as absent
    if not _DEC.match(t):
        return None
    v = float(t)
    return v if math.isfinite(v) else None


numberish = st.one_of(
    st.floats(allow_nan=True, allow_infinity=True).map(repr),
    st.integers(-10 ** 30, 10 ** 30).map(str),
    st.from_regex(r"\A[ ]{0,2}[+-]?[0-9]{0,4}\.?[0-9]{0,3}([eE][+-]?[0-9]{1,3})?[ ]{0,2}\Z"),
    st.sampled_from(["", " ", "NaN", "Infinity", "-Infinity", "1d", "1f", "0x10", "1e", ".", "+", "1_000", None]),
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(numberish, min_size=200, max_size=200))
def test_parse_number_matches_js_model(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    got = {r["i"]: r["n"] for r in df.select("i", parse_number("s").alias("n")).collect()}
    for i, v in enumerate(values):
        exp = js_number(v)
        assert (got[i] is None and exp is None) or (got[i] == exp), (v, got[i], exp)


def like_model(name, term, case_sensitive):
    """LIKE '%term%' with % and _ as wildcards and a backslash matching itself."""
    rx = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in term)
    flags = re.S if case_sensitive else re.S | re.I
    return re.search(rx, name, flags) is not None


alphabet = st.sampled_from(list("abAB%_\\' é"))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet, max_size=8), min_size=60, max_size=60),
       st.lists(st.text(alphabet, min_size=1, max_size=3), min_size=8, max_size=8))
def test_like_contains_matches_model(spark, names, terms):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    for term in terms:
        for cs in (False, True):
            got = {r["i"] for r in df.where(match(F.col("name"), term, case_sensitive=cs)).collect()}
            exp = {i for i, n in enumerate(names) if like_model(n, term, cs)}
            assert got == exp, (term, cs)
