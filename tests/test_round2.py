"""Rows that share positions, repeated landings, unreadable pages, tenants that share ids."""

import json

import pytest
from pyspark.sql import functions as F

from core_helpers import rows
from tallyspark.operators.credentials import overflowing_tokens, to_token_record
from tallyspark.operators.payloads import build_item_payload
from tallyspark.operators.settings import nameless, save_defaults
from tallyspark.operators.upsert import upsert_entities
from tallyspark.sources.pages import split_faults
from tallyspark.sources.tables import restrict_partitions
from tallyspark.streaming.incremental import landed_rows

ENTITIES = ("id long, name string, email string, phone string, note string, type string, qb_id string, tenant_id int, "
            "is_intrinsic boolean, ntn int, address string")
PAGES = "source string, requested_start long, body string, fetch_seq long"


def page(source, names, seq=0, start=1, entity="Customer"):
    recs = [{"Id": i, "DisplayName": n} if i else {"DisplayName": n} for i, n in names]
    return (source, start, json.dumps({"QueryResponse": {entity: recs}}), seq)


def sync(spark, pages, target=(), entity="Customer"):
    got, faults = landed_rows(spark.createDataFrame(pages, PAGES), 1, entity)
    types = spark.createDataFrame([(1, "Customer")], "id int, name string")
    branches = spark.createDataFrame([(1, 1), (2, 1)], "id int, tenant_id int")
    return upsert_entities(spark.createDataFrame(list(target), ENTITIES), got, types, branches), faults


def counts(r):
    return [tuple(x) for x in r.stats.select("fetched", "inserted", "updated", "rejected").collect()]


def test_two_sources_with_equal_positions(spark):
    """Both rows stand at position 1; one is rejected for its name, the other must be there."""
    held = (7, "Taken", "", "", "", None, "H", 1, False, None, "")
    r, _ = sync(spark, [page("Customer/1/1", [(None, "Taken")]), page("Customer/1/2", [(None, "Free")])], [held])
    assert [x[0] for x in rows(r.entities, "name")] == ["Free", "Taken"]
    assert rows(r.rejects, "name", "branch_id") == [("Taken", 1)]
    assert counts(r) == [(2, 1, 0, 1)]


def test_the_later_landing_holds(spark):
    r, _ = sync(spark, [page("Customer/1/1", [("5", "Zold")], seq=1), page("Customer/1/1", [("5", "Anew")], seq=2)])
    assert [x[0] for x in rows(r.entities, "name")] == ["Anew"]
    assert counts(r) == [(2, 1, 1, 0)]


def test_every_row_is_accounted_for(spark):
    """Repeated ids, null ids, equal positions, clashes and a chain of renames."""
    held = [(i, f"n{i}", "", "", "", None, f"q{i}", 1, False, None, "") for i in range(6)]
    chain = [(f"q{i}", f"n{i + 1}") for i in range(5)]  # q0 -> n1, q1 -> n2, ...; q5 keeps n5
    pages = [page("Customer/1/1", chain), page("Customer/1/2", [(None, "x"), (None, "X"), ("new", "y"), ("new", "z")]),
             page("Customer/1/9", [(None, "w"), ("bad", "v")]), page("Customer/1", [(None, "default branch")])]
    r, faults = sync(spark, pages, held)
    assert faults.count() == 0
    got = rows(r.entities, "qb_id", "name")
    assert got == sorted([(f"q{i}", f"n{i}") for i in range(6)] + [("new", "z"), (None, "x"), (None, "default branch")], key=repr)
    assert counts(r) == [(12, 3, 1, 8)] and r.rejects.count() == 8


def test_null_type_is_counted(spark):
    rows_ = spark.createDataFrame([(1, 1, 1, "a", None, None, 1)], "batch_no int, tenant_id int, pos long, name string, qb_id string, type string, branch_id int")
    r = upsert_entities(spark.createDataFrame([], ENTITIES), rows_, spark.createDataFrame([(1, "Customer")], "id int, name string"),
                        spark.createDataFrame([(1, 1)], "id int, tenant_id int"))
    assert counts(r) == [(1, 0, 0, 1)]


def test_unreadable_and_foreign_pages_are_faults(spark):
    good = page("Customer/1/1", [("1", "a")])
    bad = [("Customer/1/1", 1001, good[2][:-5], 0), ("Customer/1/1", 2001, "<html>busy</html>", 0), ("Customer/1/1", 3001, None, 0), ("Customer/1/1", 4001, "{}", 0)]
    df = spark.createDataFrame([good, *bad, ("Customer/1/1", 5001, '{"QueryResponse":{}}', 0)], PAGES)
    ok, faults = split_faults(df, "Customer")
    assert rows(ok, "requested_start") == [(1,), (5001,)] and faults.count() == 4
    with pytest.raises(Exception, match="Unreadable page"):
        split_faults(df, "Customer", mode="fail")[0].collect()
    _, faults = landed_rows(spark.createDataFrame([good, page("Vendor/1/1", [("1", "v")], entity="Vendor"), page("Customer", [("2", "b")])], PAGES), 1)
    assert rows(faults, "fault") == [("Page of another entity",), ("Page without a tenant",)]


def test_versions_stay_within_the_tenant(spark):
    items = spark.createDataFrame([(1, "a", "5"), (2, "b", "5"), (3, "c", "5"), (1, "d", ""), (1, "e", "0"), (1, "f", None)],
                                  "tenant_id int, name string, qb_item_id string")
    items = items.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("sku", "string"), ("description", "string"), ("price", "double"), ("type", "string"), ("qty_on_hand", "double"))])
    current = spark.createDataFrame([(1, "5", "3"), (1, "5", "12"), (2, "5", "9")], "tenant_id int, Id string, SyncToken string")
    r = build_item_payload(items, current, "2024-06-01", by=["tenant_id"])
    assert rows(r.payloads, "name", "sync_token") == [("a", "12"), ("b", "9"), ("d", None), ("e", None), ("f", None)]
    assert rows(r.rejects, "name") == [("c",)]


def test_a_number_that_does_not_fit(spark):
    cols = ["tenant_id", "realm_id", "state", "latency", "id_token", "createdAt", "expires_in", "token_type", "access_token", "refresh_token", "x_refresh_token_expires_in"]
    df = spark.createDataFrame([("1", "r", "s", "99999999999", "i", "1e30", "3600", "t", "a", "b", "5"), ("2", "r", "s", "1", "i", "2", "3", "t", "a", "b", "5")], cols)
    assert rows(to_token_record(df), "tenant_id", "latency", "created_at", "expires_in") == [("1", None, None, 3600), ("2", 1, 2, 3)]
    assert rows(overflowing_tokens(df), "tenant_id") == [("1",)]


def test_saves_without_a_name(spark):
    saves = spark.createDataFrame([(None, "1", "a", 1), ("", "2", "b", 2), (" ", "3", "c", 3), ("k", "4", "d", 4)], "name string, qb_id string, qb_name string, seq long").withColumn("sub", F.lit(0))
    target = spark.createDataFrame([], "name string, qb_id string, qb_name string")
    assert rows(save_defaults(target, saves)) == [("k", "4", "d")] and nameless(saves).count() == 3


def test_partition_values_with_quotes(spark):
    df = spark.createDataFrame([("o'k", 1), ("b\\s", 2), ("z", 3)], "p string, v int")
    keys = df.where("v < 3").select("p")
    assert rows(restrict_partitions(df, keys, ["p"]), "v") == [(1,), (2,)]
    assert rows(restrict_partitions(df, keys, ["p"], negate=True), "v") == [(3,)]
