"""Ids (U10), mapping (U7), payloads (P17/J4), settings (J6/U9), credentials
(P15/P16/W1/J8), audits (Q1-Q7), the driver contract and the stream (T1)."""

import json

from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.operators.credentials import connection_status, decrypt_cols, encrypt_cols, latest_by
from tallyspark.operators.ids import assign_ids
from tallyspark.operators.mapping import apply_mappings
from tallyspark.operators.payloads import build_item_payload
from tallyspark.operators.settings import defaults_coverage, fan_out_tax_rate
from tallyspark.operators.validate import audit_table, audit_table_unique, audit_unique, default_fill, require


def test_assign_ids_dense_any_partitioning(spark):
    df = spark.range(0, 5000, 3).select((F.col("id") * 7 % 5000).alias("k")).repartition(13)
    for n in (None, 1, 4, 9):
        out = assign_ids(df, ["k"], start=100, num_partitions=n)
        got = sorted((r["k"], r["id"]) for r in out.collect())
        assert [i for _, i in got] == list(range(100, 100 + len(got)))


def test_apply_mappings(spark):
    ents = spark.createDataFrame([(1, "A", "", "", "", None, None, 0, False, None, ""),
                                  (1, "A1", "", "", "", None, "old", 1, False, None, ""),
                                  (2, "B", "", "", "", "Vendor", None, 0, False, None, "")], S.ENTITIES)
    skus = spark.createDataFrame([(10, 1, None, 0, "S", 1.0, 5.0)], S.SKUS)
    assigns = spark.createDataFrame([(1, 1, 1, 0), (2, 2, 2, 0), (3, 1, 1, 1)], S.ENTITY_ASSIGNMENTS)
    types = spark.createDataFrame([(i + 1, n) for i, n in enumerate(S.ENTITY_TYPE_NAMES)], S.ENTITY_TYPES)
    m = spark.createDataFrame([(1, "Q1", "Customer", 0, 1), (1, "Q2", "Customer", 0, 2), (1, "QX", "Vendor", 0, 3),
                               (10, "I10", "MenuItem", 0, 1), (2, "", "Vendor", 0, 1), (2, "Z", "Bank", 0, 1),
                               (1, "T1", "Customer", 1, 1)],
                              "internal_id long, external_id string, type string, tenant_id int, seq long")
    r = apply_mappings(ents, skus, m, assignments=assigns, types=types)
    got = sorted((x["id"], x["tenant_id"], x["qb_id"]) for x in r.entities.collect())
    assert got == [(1, 0, "Q2"), (1, 1, "T1"), (2, 0, None)]  # same id, other tenant: its own mapping
    assert r.skus.first()["qb_id"] == "I10"
    assert r.rejects.count() == 1
    col = apply_mappings(ents, skus, m, type_source="column")
    assert sorted((x["id"], x["tenant_id"], x["qb_id"]) for x in col.entities.collect()) == \
        [(1, 0, None), (1, 1, "old"), (2, 0, None)]


def test_item_payload_json(spark):
    items = spark.createDataFrame([("Cold Brew", "ITM-1", "d", None, None, None, None),
                                   ("Svc", None, None, 120.0, "Service", None, 5),
                                   ("Gone", None, None, 1.0, "Service", None, 6)],
                                  "name string, sku string, description string, price double, type string, "
                                  "qty_on_hand double, qb_item_id long")
    current = spark.createDataFrame([("5", "3")], "Id string, SyncToken string")
    r = build_item_payload(items, current, "2024-06-01")
    bodies = {json.loads(p["payload"])["Name"]: json.loads(p["payload"]) for p in r.payloads.collect()}
    cb = bodies["Cold Brew"]
    assert cb["Type"] == "Inventory" and cb["UnitPrice"] == 0.0 and cb["QtyOnHand"] == 0.0
    assert cb["TrackQtyOnHand"] is True and cb["InvStartDate"] == "2024-06-01" and "Id" not in cb
    assert cb["ExpenseAccountRef"] == {"value": "80", "name": "Cost of Goods Sold"}
    svc = bodies["Svc"]
    assert (svc["Id"], svc["SyncToken"]) == ("5", "3") and "QtyOnHand" not in svc and "AssetAccountRef" not in svc
    assert [x["name"] for x in r.rejects.collect()] == ["Gone"]


def test_settings_fan_out_and_coverage(spark):
    saves = spark.createDataFrame([("tax_code", "T1", "GST", "R9", 1), ("cash_account", "C", "Cash", None, 2)],
                                  "name string, qb_id string, qb_name string, tax_rate_ref_id string, seq long")
    fo = sorted((r["name"], r["qb_id"], r["qb_name"]) for r in fan_out_tax_rate(saves).collect())
    assert fo == [("cash_account", "C", "Cash"), ("tax_code", "T1", "GST"), ("tax_rate_ref", "R9", "Tax Rate Ref")]
    saved = spark.createDataFrame([("tax_code", "T1", "GST"), ("customers_synced", "1", "Synced"),
                                   ("cash_account", None, None)], "name string, qb_id string, qb_name string")
    cov = {r["name"]: r["status"] for r in defaults_coverage(spark.range(1), saved).collect()}
    assert len(cov) == 11 and cov["tax_code"] == "assigned" and cov["walk_in_customer"] == "Unassigned"
    assert cov["cash_account"] == "assigned"  # a saved row counts, even with NULL values
    assert cov["customers_synced"] == "Synced" and cov["vendors_synced"] == "Not synced"


def test_credentials(spark):
    t = spark.createDataFrame([(1, "r1", "at", 0, 3600, 86400, "2024-01-01 00:00:00"),
                               (1, "r2", "bt", 0, 3600, 86400, "2024-01-01 00:00:00"),
                               (2, "r1", "ct", 0, 3600, 10, "2024-01-02 00:00:00")],
                              "tenant_id int, realm_id string, access_token string, created_at long, expires_in int, "
                              "x_refresh_token_expires_in int, updated_at string").withColumn(
        "updated_at", F.col("updated_at").cast("timestamp"))
    assert [r["realm_id"] for r in latest_by(t, ["tenant_id"], ["updated_at", "realm_id"]).orderBy("tenant_id").collect()] \
        == ["r2", "r1"]  # tie on the timestamp: realm breaks it
    enc = encrypt_cols(t, ["access_token"], "k")
    assert enc.schema["access_token"].dataType.typeName() == "binary"
    assert [r[0] for r in decrypt_cols(enc, ["access_token"], "k").select("access_token").collect()] == ["at", "bt", "ct"]
    tenants = spark.createDataFrame([(1,), (2,), (3,)], "tenant_id int")
    st = {r["tenant_id"]: r["status"] for r in connection_status(tenants, t, now_ms=3600 * 1000 + 5).collect()}
    assert st == {1: "connected", 2: "needs_reconnect", 3: "not_connected"}


def test_audits(spark):
    df = spark.createDataFrame([("Café", 1), ("cafe", 1), ("x", None), ("x", None)], "name string, tenant_id int")
    assert audit_unique(df, ["name", "tenant_id"]).count() == 0
    assert [r["n"] for r in audit_unique(df, ["name", "tenant_id"], collation="UNICODE_CI_AI").collect()] == [2]
    filled = default_fill(spark.createDataFrame([(1, None)], "id long, ratio double"), S.RULES["skus"], S.SKUS)
    r = filled.first()
    assert r["ratio"] is None and r["alert_threshold"] == 5.0  # explicit NULL stays, absent gets default
    req = require(spark.createDataFrame([(0, "a"), (1, "")], "i long, s string"), ["i", "s"])
    assert [x["reason"] for x in req.collect()] == ["Missing required fields: i", "Missing required fields: s"]


def test_declared_rules(spark):
    """NOT NULL, DEFAULT and UNIQUE as the source tables declare them."""
    skus = spark.createDataFrame([(1, 1, "a", None, 5.0), (2, 1, "A", 1.0, None), (3, 2, "a", 1.0, 5.0)],
                                 "id long, tenant_id int, sku string, ratio double, alert_threshold double")
    assert sorted((r["key"], r["column_name"]) for r in audit_table(skus, "skus").collect()) == [("1|1", "ratio"), ("2|1", "alert_threshold")]
    assert [(r["table_name"], r["n"]) for r in audit_table_unique(skus, "skus").collect()] == [("skus", 2)]
    for name, schema in (("menu_categories", S.MENU_CATEGORIES), ("menu_items", S.MENU_ITEMS)):
        filled = default_fill(spark.createDataFrame([(1,)], "id long"), S.RULES[name], schema)
        assert filled.first()["tenant_id"] == 1 and filled.schema["tenant_id"].dataType == schema["tenant_id"].dataType
    for name, key in (("entities", "name"), ("qb_defaults", "name")):
        df = spark.createDataFrame([("Café", 1), ("cafe", 1), ("x", 1), (None, 1), (None, 1)], f"{key} string, tenant_id int")
        assert [r["n"] for r in audit_table_unique(df, name).collect()] == [2]


def test_driver_contract(spark):
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 40
    df = E.entry(spark)
    assert df.count() > 0 and "qb_id" in df.columns


def test_token_record_roundtrip_and_status_class(spark):
    from tallyspark.operators.credentials import from_token_record, to_token_record
    from tallyspark.sources.pages import status_ok
    p = spark.createDataFrame([(1, "r", "s", "12.5", None, "1700000000000", "3600", "bearer", "a", "b", "x")],
                              "tenant_id int, realm_id string, state string, latency string, id_token string, "
                              "createdAt string, expires_in string, token_type string, access_token string, "
                              "refresh_token string, x_refresh_token_expires_in string")
    rec = to_token_record(p).first()
    assert (rec["latency"], rec["created_at"], rec["expires_in"], rec["x_refresh_token_expires_in"]) == \
        (13, 1700000000000, 3600, None)
    back = from_token_record(to_token_record(p).withColumn("access_token", F.col("access_token").cast("binary"))).first()
    assert back["access_token"] == "a" and back["realmId"] == "r"
    st = spark.createDataFrame([(200,), (201,), (404,), (500,)], "s int")
    assert [r[0] for r in st.select(status_ok(F.col("s"))).collect()] == [True, True, False, False]


def test_upsert_twice_equals_once(spark):
    """Re-applying a batch without NULL ids (and no rejects) changes nothing."""
    from tallyspark.operators.upsert import upsert_entities
    t = spark.createDataFrame([(1, "A", "", "", "keep", None, "7", 0, False, None, "")], S.ENTITIES)
    b = spark.createDataFrame([(0, 0, 0, "A2", "e", None, None, None, "7", "Customer", 1),
                               (0, 0, 1, "B", None, None, None, None, "8", "Vendor", 1)],
                              "batch_no int, tenant_id int, pos long, name string, email string, phone string, "
                              "address string, note string, qb_id string, type string, branch_id int")
    types = spark.createDataFrame([(i + 1, n) for i, n in enumerate(S.ENTITY_TYPE_NAMES)], S.ENTITY_TYPES)
    br = spark.createDataFrame([(1, 0, "Main")], S.BRANCHES)
    once = upsert_entities(t, b, types, br).entities.checkpoint()
    twice = upsert_entities(once, b, types, br).entities
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    from tallyspark.operators.upsert import check_inserts, prepare_batch
    checked = check_inserts(prepare_batch(b), types, br)
    checked.collect()
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan  # the type lookup is broadcast
