"""Landed pages (S1-S3, A1), serialised batches (S5, A4), sinks."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.sources.batch import NOT_ARRAY, batch_length, parse_sync_batch, sync_batch_rejects
from core_helpers import rows
from tallyspark.sources.pages import (LANDED_PAGE, audit_pages, count_records, explode_pages, pack_pages,
                                      split_faults)
from tallyspark.sources.tables import commit_table, current_pointer, read_table


def _pages(spark, rows):
    return spark.createDataFrame(rows, StructType(LANDED_PAGE.fields[:3]))


def _body(entity, records, start):
    return json.dumps({"QueryResponse": {entity: records, "startPosition": start, "maxResults": len(records)},
                       "time": "2024-01-01T00:00:00-07:00"})


def test_explode_missing_array_and_positions(spark):
    pages = _pages(spark, [("C", 1, _body("Customer", [{"Id": "1"}, {"Id": "2", "DisplayName": "B"}], 1)),
                           ("C", 1001, json.dumps({"QueryResponse": {}, "time": "t"})),
                           ("C", 2001, json.dumps({"QueryResponse": {"Customer": None}}))])
    got = [(r["pos"], r["Id"], r["DisplayName"]) for r in explode_pages(pages, "Customer").collect()]
    assert sorted(got) == [(1, "1", None), (2, "2", "B")]
    assert count_records(pages, "Customer").first()["n_records"] == 2


def test_fault_split_and_fail(spark):
    fault = json.dumps({"Fault": {"Error": [{"Message": "boom"}], "type": "SERVICE"}})
    pages = _pages(spark, [("C", 1, _body("Customer", [{"Id": "1"}], 1)), ("C", 1001, fault)])
    good, faults = split_faults(pages, "Customer")
    assert good.count() == 1
    f = faults.first()
    assert f["requested_start"] == 1001 and json.loads(f["fault"])["Error"][0]["Message"] == "boom"
    good_fail, _ = split_faults(pages, "Customer", mode="fail")
    with pytest.raises(Exception, match="API Error"):
        good_fail.collect()


def test_page_audit(spark):
    full = [{"Id": str(i)} for i in range(3)]
    pages = _pages(spark, [
        ("ok", 1, _body("Item", full, 1)), ("ok", 4, _body("Item", full[:1], 4)),
        ("gap", 1, _body("Item", full, 1)), ("gap", 7, _body("Item", full[:2], 7)),
        ("dup", 1, _body("Item", full, 1)), ("dup", 1, _body("Item", full, 1)), ("dup", 3, _body("Item", [], 3)),
        ("open", 1, _body("Item", full, 1))])
    got = {r["source"]: r for r in audit_pages(pages, "Item", page_size=3).collect()}
    assert (got["ok"]["n_gaps"], got["ok"]["terminated"], got["ok"]["n_records"]) == (0, True, 4)
    assert got["gap"]["n_gaps"] == 1
    assert got["dup"]["n_overlaps"] == 2  # a repeated start and a misaligned one
    assert got["open"]["terminated"] is False


def test_pack_pages_adds_empty_terminator(spark):
    docs = spark.range(6).select(F.col("id").alias("pos"), F.col("id").cast("string").alias("Id"))
    pages = pack_pages(docs, "Item", page_size=3)
    starts = sorted((r["requested_start"], len(json.loads(r["body"])["QueryResponse"]["Item"]))
                    for r in pages.collect())
    assert starts == [(1, 3), (4, 3), (7, 0)]
    assert sorted(r["Id"] for r in explode_pages(pages, "Item").collect()) == [str(i) for i in range(6)]


def test_parse_sync_batch(spark):
    df = spark.createDataFrame([(1, '[{"name": "a", "qbId": "7"}, {"name": "b", "qbId": null}]'), (2, "[]")],
                               "k int, j string")
    got = [(r["k"], r["pos"], r["name"], r["email"], r["qb_id"]) for r in parse_sync_batch(df, "j", keep=["k"]).collect()]
    assert got == [(1, 0, "a", None, "7"), (1, 1, "b", None, None)]
    assert [r[0] for r in df.select(batch_length(F.col("j"))).collect()] == [2, 0]
    for bad in ['{"name": "lone object"}', "12", None]:
        b = spark.createDataFrame([(bad,)], "j string")
        with pytest.raises(Exception, match="must be a JSON array"):
            parse_sync_batch(b, "j").collect()
        assert parse_sync_batch(b, "j", on_invalid="reject").count() == 0
    mixed = spark.createDataFrame([(1, '[{"name":"a","qbId":7}, 5, "x", null, {"name":"b"}]'), (2, '{"name":"lone"}'), (3, None)], "k int, j string")
    assert rows(parse_sync_batch(mixed, "j", keep=["k"], on_invalid="reject"), "k", "pos", "name", "qb_id") == [(1, 0, "a", "7"), (1, 4, "b", None)]
    assert [r[:2] for r in rows(sync_batch_rejects(mixed, "j", keep=["k"]), "k", "pos")] == [(1, 1), (1, 2), (1, 3), (2, None), (3, None)]
    with pytest.raises(Exception, match="must be a JSON object"):
        parse_sync_batch(mixed.where("k = 1"), "j").collect()
    assert NOT_ARRAY.endswith("JSON array.")


def test_versioned_table(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "id long, tenant_id int, name string")
    assert commit_table(df, root) == 0
    assert commit_table(df.where("id = 1"), root, batch_id=5) == 1
    assert current_pointer(spark, root) == (1, 5)
    assert [r["id"] for r in read_table(spark, root).collect()] == [1]
    # filter on the partition column is pruned at the scan
    plan = read_table(spark, root).where(F.col("tenant_id") == 0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "tenant_id" in plan


def test_fault_by_status_class(spark):
    landed = [("C", 1, _body("Customer", [{"Id": "1"}], 1), 200), ("C", 1001, '{"error": "busy"}', 503),
            ("C", 2001, _body("Customer", [{"Id": "3"}], 2001), 204)]
    pages = spark.createDataFrame(landed, "source string, requested_start long, body string, status int")
    good, faults = split_faults(pages, "Customer", status_col="status")
    assert sorted(r["requested_start"] for r in good.collect()) == [1, 2001]
    assert [r["fault"] for r in faults.collect()] == ['Unreadable page: {"error": "busy"}']


def test_restrict_partitions_null_keys(spark):
    from tallyspark.sources.tables import restrict_partitions
    df = spark.createDataFrame([(1, 1), (None, 2), (2, 3)], "tenant_id int, v int")
    parts = spark.createDataFrame([(1,), (None,)], "tenant_id int")
    assert sorted(r["v"] for r in restrict_partitions(df, parts, ["tenant_id"]).collect()) == [1]
    assert sorted(r["v"] for r in restrict_partitions(df, parts, ["tenant_id"], negate=True).collect()) == [2, 3]
