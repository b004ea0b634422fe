"""Search (F1-F4, W2) and the bulk candidate match (J5): blocked = nested loop."""

import random

from pyspark.sql import functions as F

from tallyspark.operators.matching import match_candidates, match_candidates_nested
from tallyspark.operators.search import search, term_ok


def test_search_wildcards_escape_and_limit(spark):
    names = [f"item {i:03d}" for i in range(60)] + ["50% off", "a_b", "back\\slash", "O'Brien"]
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(names)], "Id string, Name string")

    def hits(term, **kw):
        return sorted(r["Name"] for r in search(df, "Name", term, **kw).collect())

    assert len(hits("item")) == 50                      # limit 50
    assert len(hits("item 0")) == 50 and len(hits("item 00")) == 10
    assert hits("%") == hits("") and len(hits("")) == 50   # '%' stays a wildcard; '' matches all
    assert "a_b" in hits("a_b") and len(hits("_")) == 50
    assert hits("back\\slash") == ["back\\slash"]
    assert hits("o'brien") == ["O'Brien"]
    assert hits("O'BRIEN", case_sensitive=True) == []
    assert hits(" item 059 ") == ["item 059"] and hits(" item 059 ", trim=False) == []
    assert hits("x", min_length=2) == [] and not term_ok(" a ") and term_ok("ab")


def test_search_per_group_limit(spark):
    df = spark.range(300).select(F.format_string("%04d", "id").alias("Id"), (F.col("id") % 3).alias("t"),
                                 F.lit("thing").alias("Name"))
    out = search(df, "Name", "thin", by=["t"])
    assert sorted(r["c"] for r in out.groupBy("t").agg(F.count("*").alias("c")).collect()) == [50, 50, 50]


def test_blocked_equals_nested_loop(spark):
    rng = random.Random(7)
    words = ["red", "blue", "bolt", "ring", "gear", "rod", "café", "x_y", "50%", "Hot"]
    recs = [(rng.randrange(3), f"{i:05d}", " ".join(rng.sample(words, 2)) + f" {i % 17}") for i in range(900)]
    terms = ["red", "bolt ring", "RING", "e", "x_y", "o%r", "%%", "__", "_o_", "caf", "é", "50%", "zzz", "d b", "5",
             "16", "ho", " a "]
    trows = [(i, rng.randrange(3), t) for i, t in enumerate(terms * 3)]
    tdf = spark.createDataFrame(trows, "term_id int, tenant_id int, term string")
    rdf = spark.createDataFrame(recs, "tenant_id int, Id string, Name string")
    cols = ["term_id", "tenant_id", "term", "candidate_id", "candidate_name", "rank"]
    blocked = match_candidates(tdf, rdf, group_cols=["tenant_id"], k=7, rows_per_salt=40)
    nested = match_candidates_nested(tdf, rdf, group_cols=["tenant_id"], k=7)
    b = sorted(tuple(r[c] for c in cols) for r in blocked.collect())
    n = sorted(tuple(r[c] for c in cols) for r in nested.collect())
    assert b == n and len(b) > 100
    plan = blocked._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    # the only nested-loop join allowed is the bounded wildcard-threshold one
    assert plan.count("BroadcastNestedLoopJoin") <= 1


def test_match_routed(spark):
    from tallyspark.operators.matching import match_routed
    internal = spark.createDataFrame([(1, "Customer", " ali "), (5, "Vendor", "tech"), (1001, "MenuItem", "brew"),
                                      (7, "Bank", "x1")], "id int, type string, term string")
    cust = spark.createDataFrame([("c1", "Ali Traders", None)], "Id string, DisplayName string, Name string")
    vend = spark.createDataFrame([("v1", "Tech Supply Co.", "Tech")], "Id string, DisplayName string, Name string")
    item = spark.createDataFrame([("i1", "Cold Brew Coffee")], "Id string, Name string")
    cands, errors = match_routed(internal, {"Customer": cust, "Vendor": vend, "MenuItem": item})
    assert sorted((r["id"], r["candidate_id"]) for r in cands.collect()) == [(1, "c1"), (5, "v1"), (1001, "i1")]
    assert [r["error"] for r in errors.collect()] == ["Invalid entity type provided: Bank"]


def test_stored_table_search_pushes_down(spark):
    import __spark_entry__ as E
    from core_helpers import SF001
    df = E.queries()["search_items_tenant_table"](spark, SF001)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(Name,ring)" in plan
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "(tenant_id" in plan
    assert "TakeOrderedAndProject" in plan


def test_match_gram_lengths_and_spread(spark, capsys):
    """Terms blocked on three characters, two, one, or none; records and terms in one file each keep several tasks busy."""
    names = ["large ring 1", "Large%ring 2", "old_gear", "ab", "a", "", "xay", "İstanbul straße", "中文字 ring", None, "%_", "a\\b ring"]
    recs = spark.createDataFrame([(t, f"{i:03d}", f"{n} {j}" if n and j else n) for t in (1, 2) for i, (n, j) in enumerate((n, j) for n in names for j in range(5))], "t int, Id string, Name string").coalesce(1)
    terms = ["large ring", "rin%lar", "l_r", "ar%in", "r%g", "g_", "__", "%", "%%", "a\\b", "中文", "STRASSE", "straße", "r_n%2", "zzz"]
    terms = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate((t, x) for x in terms for t in (1, 2, 3) if (t != 2 or len(x) > 3))], "i int, t int, term string").coalesce(1)
    for some in (terms, terms.where("i < 5"), terms.where("term = '__'")):
        for g in (["t"], None):
            r = recs if g else recs.where("t = 1").select("Id", "Name")
            t = some if g else some.select("i", "term")
            got = match_candidates(t, r, group_cols=g, k=7, rows_per_salt=4)
            want = match_candidates_nested(t, r, group_cols=g, k=7)
            assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
    match_candidates(terms, recs, group_cols=["t"]).explain()
    assert capsys.readouterr().out.count("RoundRobinPartitioning") >= 2
