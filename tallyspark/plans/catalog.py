"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each one reads the driver's tables (through plans.demo) and runs one or more
operators over them, whole tables in, whole results out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import normalize as N
from tallyspark.plans import demo as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


@query
def q_normalize_customers(spark, sf_dir):
    return N.normalize_party(D.all_customers(spark, sf_dir), keep=["tenant_id", "pos"])


@query
def q_normalize_vendors(spark, sf_dir):
    return N.normalize_party(D.all_vendors(spark, sf_dir), keep=["tenant_id", "pos"])


# ---------------------------------------------------------------------------
# Entity sync (flagship): U11 -> U2 -> J3/J1/J2 -> U1/U3/U10
# ---------------------------------------------------------------------------

def _sync(spark, sf_dir):
    from tallyspark.operators.upsert import combine_batches, upsert_entities
    batch = combine_batches(D.customer_batch(spark, sf_dir), D.vendor_batch(spark, sf_dir))
    return upsert_entities(D.local_entities(spark, sf_dir), batch, D.entity_types(spark), D.branches(spark, sf_dir),
                           assignments=D.local_assignments(spark, sf_dir))


@query
def q_entity_upsert(spark, sf_dir):
    return _sync(spark, sf_dir).entities


@query
def q_entity_links(spark, sf_dir):
    r = _sync(spark, sf_dir)
    inserted = r.inserted.select(F.col("id").alias("entity_id"), "tenant_id")
    types = r.assignments.select(F.lit("type").alias("link_kind"), F.col("id").alias("link_id"),
                                 F.col("entity").alias("entity_id"), F.col("type").cast("long").alias("ref_id"),
                                 "tenant_id")
    branches = r.branch_links.join(inserted, "entity_id").select(
        F.lit("branch").alias("link_kind"), F.lit(None).cast("long").alias("link_id"), "entity_id",
        F.col("branch_id").cast("long").alias("ref_id"), "tenant_id")
    return types.unionByName(branches)


@query
def q_entity_rejects(spark, sf_dir):
    return _sync(spark, sf_dir).rejects


@query
def q_sync_summary(spark, sf_dir):
    return _sync(spark, sf_dir).stats


# ---------------------------------------------------------------------------
# Sources: landed pages (S1-S3, A1) and serialised batches
# ---------------------------------------------------------------------------

@query
def q_explode_pages(spark, sf_dir):
    from tallyspark.sources.pages import explode_pages
    items = explode_pages(D.item_pages(spark, sf_dir), "Item")
    return items.select("source", "pos", "Id", "SyncToken", "Name", "Type", "UnitPrice", "QtyOnHand", "Sku",
                        "Description", F.col("IncomeAccountRef.value").alias("income_ref"),
                        F.col("AssetAccountRef.value").alias("asset_ref"))


@query
def q_count_records(spark, sf_dir):
    from tallyspark.sources.pages import count_records
    return count_records(D.item_pages(spark, sf_dir), "Item")


@query
def q_page_audit(spark, sf_dir):
    from tallyspark.sources.pages import audit_pages
    pages = D.item_pages(spark, sf_dir).where(F.col("requested_start") != 1001)
    return audit_pages(pages, "Item")


@query
def q_fault_split(spark, sf_dir):
    from tallyspark.sources.pages import array_size, split_faults
    good, faults = split_faults(D.item_pages_with_faults(spark, sf_dir), "Item", mode="reject")
    ok = good.select("source", "requested_start", F.lit("ok").alias("status"),
                     array_size(F.col("page.QueryResponse.Item")).cast("long").alias("n_records"),
                     F.lit(None).cast("string").alias("fault_message"))
    bad = faults.select("source", "requested_start", F.lit("fault").alias("status"), F.lit(0).cast("long").alias("n_records"),
                        F.get_json_object("fault", "$.Error[0].Message").alias("fault_message"))
    return ok.unionByName(bad)


@query
def q_parse_sync_batch(spark, sf_dir):
    from tallyspark.operators.upsert import collapse_batch
    from tallyspark.sources.batch import parse_sync_batch
    batches = D.event_batches(spark, sf_dir)
    rows = parse_sync_batch(batches, "json_data", keep=["tenant_id", "batch_no"])
    return collapse_batch(rows)


# ---------------------------------------------------------------------------
# Search (F1-F4, W2) and result rows
# ---------------------------------------------------------------------------

def _search(df, field, term, **kw):
    from tallyspark.operators.search import search
    return search(df, field, term, by=["tenant_id"], **kw)


@query
def q_search_customers(spark, sf_dir):
    hits = _search(D.all_customers(spark, sf_dir), "DisplayName", "er#00000")
    return N.customer_search_row(hits, keep=["tenant_id"])


@query
def q_search_accounts(spark, sf_dir):
    hits = _search(D.remote_accounts(spark, sf_dir), "Name", " urgent ")
    return N.account_row(hits, keep=["tenant_id"])


@query
def q_search_payment_methods(spark, sf_dir):
    hits = _search(D.remote_payment_methods(spark, sf_dir), "Name", "high")
    return N.payment_method_row(hits, keep=["tenant_id"])


@query
def q_search_tax_codes(spark, sf_dir):
    hits = _search(D.remote_tax_codes(spark, sf_dir), "Name", "SUPPLIER#00000")
    return N.tax_code_row(hits, keep=["tenant_id"])


@query
def q_search_service_items(spark, sf_dir):
    hits = _search(D.remote_items(spark, sf_dir), "Name", "bolt", where=F.col("Type") == "Service")
    return N.service_item_row(hits, keep=["tenant_id"])


@query
def q_search_vendors(spark, sf_dir):
    hits = _search(D.all_vendors(spark, sf_dir), "DisplayName", "v2", trim=False)
    return N.mapping_row(hits).select("tenant_id", "Id", "DisplayName", "map_id", "map_display_name",
                                      "map_company_name")


@query
def q_search_items(spark, sf_dir):
    hits = _search(D.remote_items(spark, sf_dir), "Name", "RING", trim=False)
    return N.mapping_row(hits).select("tenant_id", "Id", "Name", "FullyQualifiedName", "map_id",
                                      "map_display_name", "map_company_name")


@query
def q_tax_codes_first_rate(spark, sf_dir):
    return N.tax_code_row(D.remote_tax_codes(spark, sf_dir))


@query
def q_result_labels(spark, sf_dir):
    """P12, P13 over every kind of search result."""
    def kind(label, rows, /, **cols):
        parts = {c: F.lit(None).cast("string") for c in ("display_name", "name", "company_name", "account_type", "tax_rate_ref_id", "payment_type")}
        parts |= {c: F.col(v) for c, v in cols.items()}
        return rows.select(F.lit(label).alias("kind"), F.col("id"), *[v.alias(c) for c, v in parts.items()])

    vendors = N.mapping_row(D.all_vendors(spark, sf_dir)).select(F.col("map_id").alias("id"), "map_display_name", "map_company_name")
    items = N.service_item_row(D.remote_items(spark, sf_dir).where(F.col("Type") == "Service"))
    rows = [kind("customer", N.customer_search_row(D.all_customers(spark, sf_dir)), display_name="display_name", company_name="company_name"),
            kind("vendor", vendors, display_name="map_display_name", company_name="map_company_name"),
            kind("account", N.account_row(D.remote_accounts(spark, sf_dir)), name="name", account_type="account_type"),
            kind("payment_method", N.payment_method_row(D.remote_payment_methods(spark, sf_dir)), name="name", payment_type="payment_type"),
            kind("service_item", items, name="name", account_type="account_type"),
            kind("tax_code", N.tax_code_row(D.remote_tax_codes(spark, sf_dir)), name="name", tax_rate_ref_id="tax_rate_ref_id")]
    rows = reduce(DataFrame.unionByName, rows)
    return rows.select("kind", "id", N.result_label(F.col("display_name"), F.col("name")).alias("label"),
                       N.result_meta(F.col("company_name"), F.col("account_type"), F.col("tax_rate_ref_id"),
                                     F.col("payment_type")).alias("meta"))


@query
def q_company_profile(spark, sf_dir):
    return N.company_profile(D.company_infos(spark, sf_dir), keep=["tenant_id"])


# ---------------------------------------------------------------------------
# Matching and mapping
# ---------------------------------------------------------------------------

def _match_inputs(spark, sf_dir):
    return D.unmapped_item_terms(spark, sf_dir), D.remote_items(spark, sf_dir).select("tenant_id", "Id", "Name")


@query
def q_match_candidates(spark, sf_dir):
    from tallyspark.operators.matching import match_candidates
    terms, records = _match_inputs(spark, sf_dir)
    return match_candidates(terms, records, group_cols=["tenant_id"])


@query
def q_apply_mappings(spark, sf_dir):
    from tallyspark.operators.mapping import apply_mappings
    r = apply_mappings(D.local_entities(spark, sf_dir), D.local_skus(spark, sf_dir), D.mapping_instructions(spark, sf_dir),
                       assignments=D.local_assignments(spark, sf_dir), types=D.entity_types(spark))
    action, display = N.mapping_action(F.col("old_qb_id"))
    return r.applied.select("*", action.alias("action"), display.alias("display"))


@query
def q_required_split(spark, sf_dir):
    from tallyspark.operators.search import term_ok_col
    from tallyspark.operators.validate import require
    req = D.mapping_requests(spark, sf_dir)
    return require(req, ["internal_id", "external_id", "type"]).withColumn("term_ok", term_ok_col(F.col("term")))


# ---------------------------------------------------------------------------
# Settings (U4, U5, U8, U9, J6)
# ---------------------------------------------------------------------------

def _defaults_after_saves(spark, sf_dir):
    from tallyspark.operators.settings import fan_out_tax_rate, save_defaults, sync_markers
    saves = fan_out_tax_rate(D.default_saves(spark, sf_dir))
    markers = sync_markers(D.synced_tenants(spark, sf_dir), "customers_synced", seq=10 ** 12)
    return save_defaults(D.saved_defaults(spark, sf_dir), saves.unionByName(markers), by=["tenant_id"])


@query
def q_upsert_defaults(spark, sf_dir):
    return _defaults_after_saves(spark, sf_dir)


@query
def q_defaults_coverage(spark, sf_dir):
    from tallyspark.operators.settings import defaults_coverage
    return defaults_coverage(D.setting_scopes(spark, sf_dir), _defaults_after_saves(spark, sf_dir), by=["tenant_id"])


@query
def q_insert_ignore(spark, sf_dir):
    from tallyspark.operators.upsert import insert_ignore
    c = D.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    src = c.select((F.col("c_custkey") % 9 + 1).cast("int").alias("id"),
                   (F.col("c_nationkey") % 4).cast("int").alias("tenant_id"), F.col("c_name").alias("name"),
                   F.col("c_custkey").alias("seq"))
    return insert_ignore(D.branches(spark, sf_dir), src, ["id", "tenant_id"], order_col="seq")


# ---------------------------------------------------------------------------
# Credentials
# ---------------------------------------------------------------------------

SECRET = "demo-secret"
NOW_MS = D.BASE_MS + 30 * 86400 * 1000


@query
def q_token_records(spark, sf_dir):
    from tallyspark.operators.credentials import to_token_record
    from tallyspark.operators.validate import require
    rec = to_token_record(D.token_payloads(spark, sf_dir), keep=["tenant_id", "realm_id", "seq"])
    return require(rec, ["access_token", "refresh_token"])


@query
def q_token_upsert(spark, sf_dir):
    """U4 on (tenant, realm): stored tokens (of the even customers) meet new payloads (of the odd ones)."""
    from tallyspark.operators.credentials import to_token_record
    from tallyspark.operators.upsert import dedupe_last, upsert
    from tallyspark.operators.validate import require
    cols = ["state", "created_at", "access_token"]
    rec = to_token_record(D.token_payloads(spark, sf_dir), keep=["tenant_id", "realm_id", "seq"])
    ok = require(rec, ["access_token", "refresh_token"]).where("accepted").select("tenant_id", "realm_id", "seq", *cols)
    stored = dedupe_last(ok.where("seq % 2 = 0"), ["tenant_id", "realm_id"], "seq").drop("seq")
    return upsert(stored, ok.where("seq % 2 = 1"), ["tenant_id", "realm_id"], cols, order_col="seq")


@query
def q_encrypt_roundtrip(spark, sf_dir):
    from tallyspark.operators.credentials import SECRET_COLUMNS, decrypt_cols, encrypt_cols
    t = D.token_table(spark, sf_dir).select("tenant_id", "realm_id", *SECRET_COLUMNS)
    t = t.select("*", *[F.col(c).alias("_plain_" + c) for c in SECRET_COLUMNS])
    enc = encrypt_cols(t, SECRET_COLUMNS, SECRET)
    enc = enc.withColumn("cipher_len", F.octet_length("access_token"))
    dec = decrypt_cols(enc, SECRET_COLUMNS, SECRET)
    same = F.lit(True)
    for c in SECRET_COLUMNS:
        same = same & F.col(c).eqNullSafe(F.col("_plain_" + c))
    return dec.select("tenant_id", "realm_id", *SECRET_COLUMNS, "cipher_len", same.alias("roundtrip_ok"))


@query
def q_latest_by(spark, sf_dir):
    from tallyspark.operators.credentials import latest_by
    t = D.token_table(spark, sf_dir)
    return latest_by(t, ["tenant_id"], ["updated_at", "realm_id"]).select("tenant_id", "realm_id", "updated_at",
                                                                        "created_at", "state")


@query
def q_connection_status(spark, sf_dir):
    from tallyspark.operators.credentials import connection_status
    tenants = D.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 120).cast("int").alias("tenant_id"))
    return connection_status(tenants, D.token_table(spark, sf_dir), NOW_MS)


@query
def q_auto_touch(spark, sf_dir):
    from tallyspark.operators.upsert import auto_touch
    old = D.token_table(spark, sf_dir)
    new = old.withColumn("access_token", F.when(F.col("tenant_id") % 3 == 0, F.concat(F.lit("new-"), F.col("access_token")))
                         .otherwise(F.col("access_token"))).drop("updated_at")
    compare = [c for c in new.columns if c not in ("tenant_id", "realm_id")]
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    out = auto_touch(old, new, ["tenant_id", "realm_id"], compare, "updated_at", now)
    return out.select("tenant_id", "realm_id", "access_token", "updated_at", (F.col("updated_at") == now).alias("touched"))


# ---------------------------------------------------------------------------
# Item payloads (P17, J4) and number parsing
# ---------------------------------------------------------------------------

@query
def q_item_payload(spark, sf_dir):
    from tallyspark.operators.payloads import build_item_payload
    # Every remote id exists in all four tenants with another token, and twice in each.
    k = F.col("Id").cast("long")
    current = D.remote_items(spark, sf_dir).select("Id", F.explode(F.array(*map(F.lit, range(4)))).alias("tenant_id"))
    token = (k % 4 + 10 * F.col("tenant_id")).cast("string")
    current = current.select("tenant_id", "Id", F.explode(F.array(token, F.lit("-1"))).alias("SyncToken"))
    # Blank and 0 ids are creates.
    n = F.col("item_id")
    items = D.local_items(spark, sf_dir).withColumn("tenant_id", (n % 4).cast("int"))
    items = items.withColumn("qb_item_id", F.when(F.col("qb_item_id").isNotNull(), F.col("qb_item_id").cast("string"))
                             .when(n % 7 == 1, F.lit("")).when(n % 7 == 3, F.lit("0")))
    r = build_item_payload(items, current, "2024-06-01", keep=["item_id"], by=["tenant_id"])
    ok = r.payloads.select("item_id", F.lit("ok").alias("status"), "body.Name", "body.Type", "body.UnitPrice",
                           "body.QtyOnHand", "body.TrackQtyOnHand", "body.InvStartDate", "body.Id", "body.SyncToken",
                           F.col("body.IncomeAccountRef.value").alias("income_ref"),
                           F.col("body.ExpenseAccountRef.value").alias("expense_ref"),
                           F.col("body.AssetAccountRef.value").alias("asset_ref"))
    bad = r.rejects.select("item_id", F.lit("rejected").alias("status"), F.col("name").alias("Name"),
                           F.col("type").alias("Type"), F.col("price").alias("UnitPrice"),
                           F.lit(None).cast("double").alias("QtyOnHand"), F.lit(None).cast("boolean").alias("TrackQtyOnHand"),
                           F.lit(None).cast("string").alias("InvStartDate"), F.col("qb_item_id").cast("string").alias("Id"),
                           F.lit(None).cast("string").alias("SyncToken"), F.lit(None).cast("string").alias("income_ref"),
                           F.lit(None).cast("string").alias("expense_ref"), F.lit(None).cast("string").alias("asset_ref"))
    return ok.unionByName(bad)


@query
def q_parse_number(spark, sf_dir):
    from tallyspark.functions.exprs import parse_number
    e = D.table(spark, sf_dir, "events").select("event_id", "props")
    k = F.col("event_id")
    raw = (F.when(k % 10 == 0, F.lit(" 12 ")).when(k % 10 == 1, F.lit("1e3")).when(k % 10 == 2, F.lit("12x"))
           .when(k % 10 == 3, F.lit("1d")).when(k % 10 == 4, F.lit("NaN")).when(k % 10 == 5, F.lit("Infinity"))
           .when(k % 10 == 6, F.lit("")).when(k % 10 == 7, F.lit(None).cast("string"))
           .when(k % 10 == 8, F.get_json_object("props", "$.k")).otherwise(F.lit("-.5")))
    return e.select("event_id", raw.alias("raw")).select(
        "event_id", "raw", parse_number(F.col("raw")).alias("num"),
        parse_number(F.col("raw"), blank_as_zero=True).alias("num_blank_zero"))


# ---------------------------------------------------------------------------
# Audits (Q1-Q7)
# ---------------------------------------------------------------------------

@query
def q_audit_unique(spark, sf_dir):
    from tallyspark.operators.validate import audit_unique
    return audit_unique(D.part_menu_items(spark, sf_dir), ["name", "tenant_id"], "menu_items")


@query
def q_audit_primary_key(spark, sf_dir):
    from tallyspark.operators.validate import audit_primary_key
    return audit_primary_key(D.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem")


def _audited(spark, sf_dir):
    """Frames shaped like the declared tables, with repeated and NULL keys and references without a parent."""
    skus = D.local_skus(spark, sf_dir).withColumn("sku", F.concat(F.when(F.col("id") % 2 == 0, F.lit("sku-")).otherwise(F.lit("SKU-")), F.floor(F.col("id") / 8).cast("string")))
    links = D.local_assignments(spark, sf_dir).withColumn("type", F.when(F.col("id") % 14 == 0, F.lit(9)).otherwise(F.col("type")))
    return {"entities": D.order_entities(spark, sf_dir).select("id", "name", "tenant_id"), "skus": skus, "menu_items": D.part_menu_items(spark, sf_dir).where("id % 3 <> 0"),
            "qb_defaults": D.default_saves(spark, sf_dir).select(F.col("seq").alias("id"), "name", "qb_id", "qb_name"), "entity_assignments": links,
            "entity_types": D.entity_types(spark), "branches": D.branches(spark, sf_dir)}


@query
def q_audit_keys(spark, sf_dir):
    """Q1, Q2 over all declared keys of seven tables in one aggregation."""
    from tallyspark.operators.validate import audit_keys
    return audit_keys(_audited(spark, sf_dir)).withColumn("key", F.lower("key"))


@query
def q_audit_references(spark, sf_dir):
    """Q6 over the declared references between these tables."""
    from tallyspark.operators.validate import audit_references
    return audit_references({k: v for k, v in _audited(spark, sf_dir).items() if k != "entities"})


@query
def q_audit_not_null(spark, sf_dir):
    from tallyspark.operators.validate import audit_not_null
    from tallyspark.schemas import RULES
    df = D.order_entities(spark, sf_dir)
    cols = [c for c in RULES["entities"].not_null if c in df.columns]
    return audit_not_null(df, cols, ["id"], "entities")


@query
def q_audit_length(spark, sf_dir):
    from tallyspark.operators.validate import audit_length
    from tallyspark.schemas import RULES
    df = D.order_entities(spark, sf_dir)
    return audit_length(df, {c: n for c, n in RULES["entities"].lengths.items() if c in df.columns}, ["id"], "entities")


@query
def q_audit_domain(spark, sf_dir):
    from tallyspark.operators.validate import audit_domain
    from tallyspark.schemas import RULES
    df = D.order_entities(spark, sf_dir).select("id", F.col("type").alias("name"))
    return audit_domain(df, RULES["entity_types"].domains, ["id"], "entity_types")


@query
def q_audit_reference(spark, sf_dir):
    from tallyspark.operators.validate import audit_reference
    return audit_reference(D.lineitem_skus(spark, sf_dir), ["menu_item_id", "tenant_id"],
                           D.part_menu_items(spark, sf_dir), ["id", "tenant_id"], ["l_orderkey", "l_linenumber"],
                           "skus", "menu_items")


@query
def q_default_fill(spark, sf_dir):
    from tallyspark.operators.validate import default_fill
    from tallyspark.schemas import RULES, SKUS
    return default_fill(D.lineitem_skus(spark, sf_dir), RULES["skus"], SKUS)


# ---------------------------------------------------------------------------
# Sinks (S4, S6, S7, F6)
# ---------------------------------------------------------------------------

@query
def q_snapshot_roundtrip(spark, sf_dir):
    from tallyspark import schemas as S
    from tallyspark.session import shared_path
    from tallyspark.sources.tables import scan, write_snapshot
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType
    path = shared_path(spark, "snapshots", "items")
    write_snapshot(D.remote_items(spark, sf_dir), path)
    schema = StructType([StructField("tenant_id", IntegerType()), StructField("pos", LongType()), *S.ITEM_DOC.fields])
    return scan(spark, path, ["tenant_id", "Id", "Name", "UnitPrice", "Type", "QtyOnHand"], fmt="json", schema=schema)


@query
def q_commit_table_roundtrip(spark, sf_dir):
    from tallyspark.session import shared_path
    from tallyspark.sources.tables import commit_table, read_table
    root = shared_path(spark, "tables", "entities")
    commit_table(D.local_entities(spark, sf_dir), root)
    from tallyspark import schemas as S
    return read_table(spark, root).select(*S.ENTITY_COLUMNS)


# ---------------------------------------------------------------------------
# Streaming
# ---------------------------------------------------------------------------

def _streamed(spark, sf_dir):
    """Root of a table that two streams have filled from nothing: the local entities come by a batch job, then the
    customers and the vendors of all tenants by one stream each, with two customer runs that must not be applied."""
    from tallyspark import schemas as S
    from tallyspark.session import shared_path
    from tallyspark.sources.pages import land_pages
    from tallyspark.sources.tables import init_partitioned
    from tallyspark.streaming.incremental import start_sync
    root = shared_path(spark, "tables", "stream_entities")
    init_partitioned(D.local_entities(spark, sf_dir), root, buckets=16)
    checkpoints = shared_path(spark, "stream_checkpoints")
    for entity, pages in (("Customer", [D.customer_pages(spark, sf_dir), D.faulted_customer_pages(spark, sf_dir)]), ("Vendor", [D.vendor_pages(spark, sf_dir)])):
        landing = shared_path(spark, "landing", entity)
        for p in pages:
            land_pages(p, landing, mode="append")
        start_sync(spark, landing, root, f"{checkpoints}/{entity}", D.entity_types(spark), D.branches(spark, sf_dir), entity).awaitTermination()
    return root


@query
def q_incremental_sync(spark, sf_dir):
    """The table after both streams (T1), tenant by tenant and in 16 hashed-id buckets each."""
    from tallyspark import schemas as S
    from tallyspark.sources.tables import read_partitions
    return read_partitions(spark, _streamed(spark, sf_dir)).select(*S.ENTITY_COLUMNS)


@query
def q_sync_markers(spark, sf_dir):
    """U8: the markers and summaries that the two streams leave: every tenant's runs were applied, the faulted ones not."""
    from tallyspark.streaming.incremental import read_settings
    root = _streamed(spark, sf_dir)
    told = spark.read.parquet(f"{root}/_side/summary").groupBy("tenant_id", "type").agg(*[F.sum(c).alias(c) for c in ("fetched", "inserted", "updated", "rejected")])
    marker = F.when(F.col("name") == "customers_synced", F.lit("Customer")).otherwise(F.lit("Vendor"))
    marks = read_settings(spark, root).select("tenant_id", marker.alias("type"), "name", "qb_id", "qb_name")
    return marks.join(told, ["tenant_id", "type"]).select("tenant_id", "name", "qb_id", "qb_name", "fetched", "inserted", "updated", "rejected")


@query
def q_search_items_tenant_table(spark, sf_dir):
    """F1 + F6 on a stored table: items committed partitioned by tenant, then a
    case-sensitive search for one tenant.  The tenant filter prunes
    partitions and LIKE '%ring%' reaches the parquet scan (StringContains)."""
    from tallyspark.operators.search import search
    from tallyspark.session import shared_path
    from tallyspark.sources.tables import commit_table, read_table
    root = shared_path(spark, "tables", "items")
    items = D.remote_items(spark, sf_dir).select("tenant_id", "Id", "Name", "Type", "UnitPrice")
    commit_table(items, root)
    table = read_table(spark, root).where(F.col("tenant_id") == 1)
    return search(table, "Name", "ring", case_sensitive=True).select("tenant_id", "Id", "Name", "Type", "UnitPrice")
