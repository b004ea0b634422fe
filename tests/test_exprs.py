"""Null / '' / absent matrix and scalar helpers."""

import math

from pyspark.sql import functions as F

from tallyspark.functions.exprs import (first_truthy, long_address, nz, parse_number, short_address)
from tallyspark.operators.normalize import mapping_action, result_label, result_meta


def test_nz_vs_first_truthy(spark):
    df = spark.createDataFrame([("", "b"), (None, "b"), ("a", "b"), (None, None), ("", "")], "a string, b string")
    got = [tuple(r) for r in df.select(nz(F.col("a"), F.col("b"), "z").alias("nz"),
                                       first_truthy(F.col("a"), F.col("b")).alias("ft")).collect()]
    # ?? keeps '' ; || skips it, and its last argument is returned as is
    assert got == [("", "b"), ("b", "b"), ("a", "a"), ("z", None), ("", "")]


def test_short_address(spark):
    schema = "a struct<Line1:string,City:string,CountrySubDivisionCode:string>"
    df = spark.createDataFrame([(("1 Main", "Town", "CA"),), (("", None, "CA"),), (None,), ((None, None, None),)],
                               schema)
    assert [r[0] for r in df.select(short_address("a")).collect()] == ["1 Main, Town, CA", "CA", "", ""]


def test_long_address(spark):
    schema = ("a struct<Line1:string,Line2:string,City:string,CountrySubDivisionCode:string,"
              "PostalCode:string,Country:string>")
    df = spark.createDataFrame([(("1 Main", "", "Town", "CA", "90000", "US"),), (None,),
                                (("1 Main", None, None, "", None, None),), ((None, None, None, "CA", None, "US"),)],
                               schema)
    assert [r[0] for r in df.select(long_address("a")).collect()] == [
        "1 Main, Town, CA, 90000, US", "Address unavailable", "1 Main", "CA, US"]


def test_parse_number(spark):
    vals = ["", " 12 ", "1e3", "12x", "1d", "1f", "NaN", "Infinity", "-Infinity", None, "-.5", "5.", "+7", "0x1F",
            "1e999"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [tuple(r) for r in df.select(parse_number("s"), parse_number("s", blank_as_zero=True)).collect()]
    exp = [None, 12.0, 1000.0, None, None, None, None, None, None, None, -0.5, 5.0, 7.0, None, None]
    assert [g[0] for g in got] == exp
    exp0 = list(exp)
    exp0[0] = 0.0
    exp0[9] = 0.0
    assert [g[1] for g in got] == exp0
    assert not any(isinstance(g[0], float) and math.isnan(g[0]) for g in got)


def test_labels_and_meta(spark):
    df = spark.createDataFrame([
        ("D", "N", "Co", "", None, ""), (None, "N", "", "Bank", None, ""), (None, None, None, None, "7", None),
        (None, None, "", "", "", "Cash"), (None, None, None, None, None, None)],
        "d string, n string, co string, at string, tr string, pt string")
    got = [tuple(r) for r in df.select(
        result_label(F.col("d"), F.col("n")),
        result_meta(F.col("co"), F.col("at"), F.col("tr"), F.col("pt"))).collect()]
    assert got == [("D", "Co"), ("N", "Bank"), ("Unnamed", "Tax Rate Ref: 7"), ("Unnamed", "Cash"), ("Unnamed", "")]


def test_mapping_action(spark):
    df = spark.createDataFrame([("105",), (None,), ("",)], "q string")
    a, d = mapping_action(F.col("q"))
    assert [tuple(r) for r in df.select(a, d).collect()] == [("Remap ID", "105"), ("Map ID", "Unmapped"),
                                                            ("Map ID", "Unmapped")]


def test_utc_date_of_offset_timestamp(spark):
    from tallyspark.functions.exprs import utc_date
    df = spark.createDataFrame([("2026-05-10T22:57:13-07:00",), ("2026-05-10T10:00:00+09:00",)], "t string")
    assert [str(r[0]) for r in df.select(utc_date("t")).collect()] == ["2026-05-11", "2026-05-10"]
