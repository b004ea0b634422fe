"""Document projections (P1, P5-P11) including absent fields and the
case-insensitive column-name trap."""

from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.operators import normalize as N


def _party(spark, rows):
    return spark.createDataFrame(rows, S.PARTY_DOC)


def test_normalize_party_null_matrix(spark):
    df = _party(spark, [
        ("1", "Ali Traders", None, None, ("a@x.com",), ("555",), ("L1", "City", "CA")),
        ("2", None, "Given", "", None, (None,), None),
        (None, "", None, None, ("",), None, ("", "", "")),
    ])
    got = [tuple(r) for r in N.normalize_party(df).collect()]
    assert got == [("Ali Traders", "a@x.com", "555", "L1, City, CA", "", "1"),
                   ("", "", "", "", "", "2"),
                   ("", "", "", "", "", None)]


def test_customer_search_row(spark):
    df = _party(spark, [("1", None, "Given", None, None, None, None), ("2", "", "Given", "Co", None, None, None),
                        ("3", None, None, None, None, None, None)])
    got = [tuple(r) for r in N.customer_search_row(df).collect()]
    assert got == [("1", "Given", ""), ("2", "", "Co"), ("3", "", "")]


def test_tax_code_row_out_of_bounds(spark):
    rows = [("1", "A", None), ("2", "B", ([],)), ("3", "C", ([((None,),)],)), ("4", "D", ([(("r1",),), (("r2",),)],)),
            ("5", None, (None,))]
    df = spark.createDataFrame(rows, S.TAX_CODE_DOC)
    got = [tuple(r) for r in N.tax_code_row(df).collect()]
    assert got == [("1", "A", None), ("2", "B", None), ("3", "C", None), ("4", "D", "r1"), ("5", "", None)]


def test_mapping_row_keeps_original_columns(spark):
    item = spark.createDataFrame([("9", "Widget", "Cat:Widget")], "Id string, Name string, FullyQualifiedName string")
    out = N.mapping_row(item)
    assert out.columns == ["Id", "Name", "FullyQualifiedName", "map_id", "map_display_name", "map_company_name"]
    assert tuple(out.first()) == ("9", "Widget", "Cat:Widget", "9", "Widget", "Cat:Widget")
    cust = _party(spark, [("1", "", None, "", None, None, None)]).withColumn("Name", F.lit("nm"))
    r = N.mapping_row(cust).first()
    assert (r["DisplayName"], r["map_display_name"], r["map_company_name"]) == ("", "nm", None)


def test_company_profile(spark):
    df = spark.createDataFrame([("9", "", "Legal", None), (None, None, None, ("A", None, None, None, None, None))],
                               S.COMPANY_INFO_DOC)
    got = [tuple(r) for r in N.company_profile(df).collect()]
    assert got == [("Legal", "9", "Address unavailable"), ("Unknown Company", "Unavailable", "A")]
