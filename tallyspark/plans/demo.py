"""Remote-shaped frames derived from the driver's parquet tables.

The source system pulls Customers, Vendors, Items, Accounts, ... from a remote
accounting service.  Here those documents are derived, row for row, from the
TPC-H-like tables so that every query's work grows with the data.  The rules
below are restated independently in the DuckDB oracle (plans/oracle.py).

Outcome mix for the entity sync, at every scale:
  key % 10 == 0  -> remote only      -> insert
  key % 10 == 9  -> local only       -> untouched (and unmapped: qb_id NULL)
  otherwise      -> both             -> update
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schemas as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# Customers / vendors
# ---------------------------------------------------------------------------

def _party_docs(base: DataFrame, key: str, name: str, id_prefix: str, label: Column | None = None) -> DataFrame:
    k = F.col(key)
    display = F.concat(F.col(name), F.when(k % 4 == 0, F.lit(" v2")).otherwise(F.lit("")))
    company = (F.when(k % 6 == 0, F.lit(None).cast("string"))
               .when(k % 6 == 1, F.lit(""))
               .otherwise(F.concat(label, F.lit(" Co"))))
    email = F.when(k % 3 != 0, F.struct(
        F.concat(F.lower(F.replace(F.col(name), F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("Address")))
    phone = F.struct(F.when(k % 8 != 0, F.concat(F.lit("555-"), F.lpad((k % 10000).cast("string"), 4, "0")))
                     .alias("FreeFormNumber"))
    bill = F.when(k % 20 != 3, F.struct(
        F.concat(F.lit("No "), k.cast("string")).alias("Line1"),
        F.col("n_name").alias("City"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("r_name")).alias("CountrySubDivisionCode")))
    return base.select(
        F.col("tenant_id"),
        k.alias("pos"),
        F.concat(F.lit(id_prefix), k.cast("string")).alias("Id"),
        display.alias("DisplayName"),
        label.alias("GivenName"),
        company.alias("CompanyName"),
        email.alias("PrimaryEmailAddr"),
        phone.alias("PrimaryPhone"),
        bill.alias("BillAddr"),
    )


def _with_geo(df: DataFrame, nation_col: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation and region are tiny dimension tables (25 and 5 rows in TPC-H at any
    # scale): a broadcast join never grows with the fact table.
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    return df.join(F.broadcast(geo), df[nation_col] == geo.n_nationkey)


def all_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer documents of the whole table."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    c = c.withColumn("tenant_id", F.col("c_nationkey") % 4)
    return _party_docs(_with_geo(c, "c_nationkey", spark, sf_dir), "c_custkey", "c_name", "",
                       F.col("c_mktsegment"))


def all_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor documents of the whole table."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    s = s.withColumn("tenant_id", F.col("s_nationkey") % 4)
    return _party_docs(_with_geo(s, "s_nationkey", spark, sf_dir), "s_suppkey", "s_name", "S",
                       F.lit("Supplier"))


def remote_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the remote system holds in the sync: keys that end in 9 exist only locally (those that end in 0 only here)."""
    return all_customers(spark, sf_dir).where(F.col("pos") % 10 != 9)


def remote_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_vendors(spark, sf_dir).where(F.col("pos") % 10 != 9)


def customer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync batch rows for the customer job: normalised customers with their
    job attributes (type, branch) and position."""
    from tallyspark.operators.normalize import normalize_party
    docs = remote_customers(spark, sf_dir)
    return (normalize_party(docs, keep=["tenant_id", "pos"])
            .withColumn("batch_no", F.lit(0))
            .withColumn("type", F.when(F.col("pos") % 13 == 0, F.lit("Client")).otherwise(F.lit("Customer")))
            .withColumn("branch_id", (F.col("pos") % 7 + 1).cast("int")))


def vendor_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.operators.normalize import normalize_party
    docs = remote_vendors(spark, sf_dir)
    return (normalize_party(docs, keep=["tenant_id", "pos"])
            .withColumn("batch_no", F.lit(1))
            .withColumn("type", F.lit("Vendor"))
            .withColumn("branch_id", (F.col("pos") % 7 + 1).cast("int")))


def local_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local entities table before the sync: customers (odd ids) and
    suppliers (even ids)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    c = c.filter(F.col("c_custkey") % 10 != 0).select(
        (F.col("c_custkey") * 2 + 1).alias("id"),
        F.col("c_name").alias("name"),
        F.lit("").alias("email"),
        F.lit("").alias("phone"),
        F.lit("keep").alias("note"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("Customer")).alias("type"),
        F.when(F.col("c_custkey") % 10 != 9, F.col("c_custkey").cast("string")).alias("qb_id"),
        (F.col("c_nationkey") % 4).alias("tenant_id"),
        F.lit(False).alias("is_intrinsic"),
        F.lit(None).cast("int").alias("ntn"),
        F.lit("").alias("address"),
    )
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    s = s.filter(F.col("s_suppkey") % 10 != 0).select(
        (F.col("s_suppkey") * 2 + 2).alias("id"),
        F.col("s_name").alias("name"),
        F.lit("").alias("email"),
        F.lit("").alias("phone"),
        F.lit("keep").alias("note"),
        F.lit("Vendor").alias("type"),
        F.when(F.col("s_suppkey") % 10 != 9, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("qb_id"),
        (F.col("s_nationkey") % 4).alias("tenant_id"),
        F.lit(False).alias("is_intrinsic"),
        F.lit(None).cast("int").alias("ntn"),
        F.lit("").alias("address"),
    )
    return c.unionByName(s).select(*S.ENTITY_COLUMNS)


def local_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_assignments for the local entities: customers type 1, vendors type 2."""
    ent = local_entities(spark, sf_dir)
    return ent.select(
        F.col("id").alias("id"),
        F.col("id").alias("entity"),
        F.when(F.col("id") % 2 == 1, F.lit(1)).otherwise(F.lit(2)).alias("type"),
        F.col("tenant_id"),
    )


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch ids 1..5 per tenant, from nation (region + 1, nation % 4);
    ids 6 and 7 never exist, so some inserts are rejected."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    keyed = n.select((F.col("n_regionkey") + 1).cast("int").alias("id"),
                     (F.col("n_nationkey") % 4).cast("int").alias("tenant_id"),
                     F.col("n_name").alias("name"), F.col("n_nationkey"))
    # First nation per (id, tenant) names the branch.
    return (keyed.groupBy("id", "tenant_id")
            .agg(F.min_by("name", "n_nationkey").alias("name")))


def entity_types(spark: SparkSession) -> DataFrame:
    """The seeded entity_types lookup (7 fixed rows)."""
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(S.ENTITY_TYPE_NAMES)], S.ENTITY_TYPES)


# ---------------------------------------------------------------------------
# Items, accounts, payment methods, tax codes, company info
# ---------------------------------------------------------------------------

def remote_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item documents from part: Type by key % 3; Inventory items carry stock
    fields; SyncToken = key % 4."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    typ = (F.when(k % 3 == 0, F.lit("Inventory")).when(k % 3 == 1, F.lit("Service"))
           .otherwise(F.lit("NonInventory")))
    inv = k % 3 == 0

    def ref(v, n):
        return F.struct(F.lit(v).alias("value"), F.lit(n).alias("name"))

    return p.select(
        (k % 4).cast("int").alias("tenant_id"),
        k.alias("pos"),
        k.cast("string").alias("Id"),
        (k % 4).cast("string").alias("SyncToken"),
        F.concat(F.col("p_name"), F.lit(" "), k.cast("string")).alias("Name"),
        F.when(k % 5 != 0, F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand"))).alias("Description"),
        (k % 11 != 0).alias("Active"),
        F.concat(F.col("p_brand"), F.lit(":"), F.col("p_name"), F.lit(" "), k.cast("string")).alias("FullyQualifiedName"),
        (k % 2 == 0).alias("Taxable"),
        F.col("p_retailprice").alias("UnitPrice"),
        typ.alias("Type"),
        ref("79", "Sales of Product Income").alias("IncomeAccountRef"),
        F.when(inv, F.col("p_type")).alias("PurchaseDesc"),
        F.round(F.col("p_retailprice") / 2, 2).alias("PurchaseCost"),
        F.when(inv, ref("80", "Cost of Goods Sold")).alias("ExpenseAccountRef"),
        F.when(inv, ref("81", "Inventory Asset")).alias("AssetAccountRef"),
        inv.alias("TrackQtyOnHand"),
        F.when(inv, F.col("p_size").cast("long")).alias("QtyOnHand"),
        F.when(inv, F.lit("2024-01-01")).alias("InvStartDate"),
        F.when(k % 7 == 0, F.concat(F.lit("ITM-"), k.cast("string"))).alias("Sku"),
        F.lit("remote").alias("domain"),
        F.lit(True).alias("sparse"),
        F.struct(F.lit("2024-01-01T00:00:00-07:00").alias("CreateTime"),
                 F.lit("2024-01-02T00:00:00-07:00").alias("LastUpdatedTime")).alias("MetaData"),
        F.lit(None).cast("string").alias("DisplayName"),
        F.lit(None).cast("string").alias("CompanyName"),
    )


def remote_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") % 4).cast("int").alias("tenant_id"),
        k.cast("string").alias("Id"),
        F.when(k % 9 != 0, F.concat(F.lit("Account "), F.col("o_orderpriority"), F.lit(" "), k.cast("string")))
        .alias("Name"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Expense"))
        .when(F.col("o_orderstatus") == "O", F.lit("Income")).alias("AccountType"),
    )


def remote_payment_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") % 4).cast("int").alias("tenant_id"),
        k.cast("string").alias("Id"),
        F.concat(F.lit("Pay "), F.col("o_orderpriority"), F.lit(" "), F.col("o_custkey").cast("string")).alias("Name"),
        F.when(k % 3 == 0, F.lit("CREDIT_CARD")).when(k % 3 == 1, F.lit("NON_CREDIT_CARD")).alias("Type"),
    )


def remote_tax_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TaxCode documents, one per supplier (tenant s_nationkey % 4): no rate
    list when key % 7 == 6, an empty detail array when key % 4 == 0, else one
    (even key) or two (odd key) rate refs, the first NULL when key % 5 == 3."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    k = F.col("s_suppkey")

    def detail(v):
        return F.struct(F.struct(v.alias("value")).alias("TaxRateRef"))

    first = detail(F.when(k % 5 != 3, F.concat(F.lit("TR"), k.cast("string"))))
    second = detail(F.concat(F.lit("TR"), (k + 100).cast("string")))
    arr = (F.when(k % 4 == 0, F.array().cast("array<struct<TaxRateRef:struct<value:string>>>"))
           .when(k % 2 == 1, F.array(first, second))
           .otherwise(F.array(first)))
    return s.select(
        (F.col("s_nationkey") % 4).cast("int").alias("tenant_id"),
        k.cast("string").alias("Id"),
        F.concat(F.lit("Tax "), F.col("s_name")).alias("Name"),
        F.when(k % 7 != 6, F.struct(arr.alias("TaxRateDetail"))).alias("SalesTaxRateList"),
    )


def company_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One CompanyInfo document per supplier (each supplier is a tenant's
    company here)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    s = _with_geo(s, "s_nationkey", spark, sf_dir)
    k = F.col("s_suppkey")
    addr = F.when(k % 10 != 7, F.struct(
        F.concat(F.lit("No "), k.cast("string")).alias("Line1"),
        F.when(k % 3 == 0, F.lit("Suite 1")).when(k % 3 == 1, F.lit("")).alias("Line2"),
        F.when(k % 4 != 1, F.col("n_name")).alias("City"),
        F.when(k % 5 != 2, F.col("r_name")).alias("CountrySubDivisionCode"),
        F.lpad((k % 100000).cast("string"), 5, "0").alias("PostalCode"),
        F.when(k % 6 != 5, F.lit("US")).alias("Country"),
    ))
    return s.select(
        k.alias("tenant_id"),
        F.when(k % 8 != 0, k.cast("string")).alias("Id"),
        F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.lit(None).cast("string"))
        .otherwise(F.col("s_name")).alias("CompanyName"),
        F.when(k % 3 != 0, F.concat(F.col("s_name"), F.lit(" LLC"))).alias("LegalName"),
        addr.alias("CompanyAddr"),
    )


# ---------------------------------------------------------------------------
# Landed pages and serialised batches
# ---------------------------------------------------------------------------

def item_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item documents packed into 1000-record response pages (position =
    p_partkey), plus the empty terminating page when the last one is full."""
    from tallyspark.sources.pages import pack_pages
    docs = remote_items(spark, sf_dir).drop("tenant_id")
    return pack_pages(docs, "Item", order_col="pos")


def item_pages_with_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page (page index % 3 == 1) comes back as a Fault."""
    from tallyspark.sources.pages import fault_body
    pages = item_pages(spark, sf_dir)
    page_no = F.floor((F.col("requested_start") - 1) / 1000)
    return pages.withColumn("body", F.when(page_no % 3 == 1, fault_body("Service unavailable"))
                            .otherwise(F.col("body")))


def event_sync_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync-entity rows from events: tenant user_id % 4, batch event_id div 500,
    external id = user id ('' when event_id % 50 == 0, absent when == 1)."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    k = F.col("event_id")
    return e.select(
        (F.col("user_id") % 4).cast("int").alias("tenant_id"),
        F.floor(k / 500).cast("int").alias("batch_no"),
        k.alias("event_id"),
        F.concat(F.col("event_type"), F.lit("#"), k.cast("string")).alias("name"),
        F.when(k % 5 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com"))).alias("email"),
        F.when(k % 2 != 0, F.concat(F.lit("555-"), F.col("user_id").cast("string"))).alias("phone"),
        F.col("props").alias("address"),
        F.lit(None).cast("string").alias("note"),
        F.when(k % 50 == 0, F.lit("")).when(k % 50 != 1, F.col("user_id").cast("string")).alias("qb_id"),
    )


def event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One serialised JSON array per (tenant, batch): at most 500 elements."""
    from tallyspark.sources.batch import to_sync_batch
    return to_sync_batch(event_sync_rows(spark, sf_dir), ["tenant_id", "batch_no"], "event_id")


# ---------------------------------------------------------------------------
# Mapping: local skus, unmapped rows as search terms, mapping instructions
# ---------------------------------------------------------------------------

def local_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """skus from part: unmapped (qb_id NULL) when p_partkey % 5 == 0."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"), F.floor(k / 2).cast("long").alias("menu_item_id"),
        F.when(k % 5 != 0, k.cast("string")).alias("qb_id"),
        (k % 4).cast("int").alias("tenant_id"),
        F.concat(F.lit("SKU-"), k.cast("string")).alias("sku"),
        F.lit(1.0).alias("ratio"), F.lit(5.0).alias("alert_threshold"))


def unmapped_item_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every local item with the text to search for: the part name; with '%'
    for the space when key % 35 == 0, '_' for 'o' when % 55 == 0, and a
    one-letter term (too short) when % 45 == 0."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey")
    term = (F.when(k % 45 == 0, F.substring("p_name", 1, 1))
            .when(k % 35 == 0, F.replace(F.col("p_name"), F.lit(" "), F.lit("%")))
            .when(k % 55 == 0, F.replace(F.col("p_name"), F.lit("o"), F.lit("_")))
            .otherwise(F.col("p_name")))
    return p.select(k.alias("term_id"), (k % 4).cast("int").alias("tenant_id"), term.alias("term"))


def mapping_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed mapping rows: unmapped customers (key % 10 == 9; a second,
    later instruction when % 20 == 19; type Vendor -- a miss -- when % 3 == 0),
    unmapped skus (Item / MenuItem; Bank when % 25 == 5 -- ignored), and
    instructions with a blank external id when p_partkey % 15 == 0."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").where(F.col("c_custkey") % 10 == 9)
    k = F.col("c_custkey")
    first = c.select((k * 2 + 1).alias("internal_id"), F.concat(F.lit("Q"), k.cast("string")).alias("external_id"),
                     F.when(k % 3 == 0, F.lit("Vendor")).otherwise(F.lit("Customer")).alias("type"),
                     (F.col("c_nationkey") % 4).cast("int").alias("tenant_id"), (k * 2).alias("seq"))
    second = c.where(k % 20 == 19).select(
        (k * 2 + 1).alias("internal_id"), F.concat(F.lit("R"), k.cast("string")).alias("external_id"),
        F.lit("Customer").alias("type"), (F.col("c_nationkey") % 4).cast("int").alias("tenant_id"),
        (k * 2 + 1).alias("seq"))
    p = table(spark, sf_dir, "part").select("p_partkey").where(F.col("p_partkey") % 5 == 0)
    q = F.col("p_partkey")
    items = p.select(q.alias("internal_id"), F.concat(F.lit("I"), q.cast("string")).alias("external_id"),
                     F.when(q % 25 == 5, F.lit("Bank")).when(q % 10 == 0, F.lit("Item")).otherwise(F.lit("MenuItem"))
                     .alias("type"), (q % 4).cast("int").alias("tenant_id"), (q * 2).alias("seq"))
    blank = p.where(q % 15 == 0).select(q.alias("internal_id"), F.lit("").alias("external_id"),
                                        F.lit("Item").alias("type"), (q % 4).cast("int").alias("tenant_id"),
                                        (q * 2 + 1).alias("seq"))
    return first.unionByName(second).unionByName(items).unionByName(blank)


def mapping_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw mapping requests from customer, some with missing fields, and the
    search term typed before each."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    return c.select(
        F.when(k % 17 != 0, k * 2 + 1).alias("internal_id"),
        F.when(k % 19 != 0, F.concat(F.lit("Q"), k.cast("string"))).otherwise(F.lit("")).alias("external_id"),
        F.when(k % 23 != 0, F.lit("Customer")).alias("type"),
        F.when(k % 4 == 0, F.lit(" a ")).when(k % 4 == 1, F.lit("ab")).when(k % 4 == 2, F.col("c_name"))
        .otherwise(F.lit("")).alias("term"))


# ---------------------------------------------------------------------------
# Settings (per tenant), tokens, local items
# ---------------------------------------------------------------------------

def _setting_key(idx):
    return F.element_at(F.array(*[F.lit(k) for k in S.SETTING_KEYS]), (idx % 9 + 1).cast("int"))


def saved_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings already saved: one per customer (none when key % 4 == 0),
    tenant = key div 9, setting = key % 9 (so (tenant, setting) is unique)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    c = c.where(k % 4 != 0)
    return c.select(F.floor(k / 9).cast("int").alias("tenant_id"), _setting_key(k).alias("name"),
                    F.concat(F.lit("c"), k.cast("string")).alias("qb_id"), F.col("c_name").alias("qb_name"))


def default_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setting saves from orders (tenant o_custkey div 9, setting o_orderkey % 9,
    in o_orderkey order); a tax_code save carries tax-rate ref 'TR' + key % 13."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    return o.select(F.floor(F.col("o_custkey") / 9).cast("int").alias("tenant_id"), _setting_key(k).alias("name"),
                    k.cast("string").alias("qb_id"), F.concat(F.lit("Account "), k.cast("string")).alias("qb_name"),
                    F.concat(F.lit("TR"), (k % 13).cast("string")).alias("tax_rate_ref_id"), k.alias("seq"))


def synced_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants whose customer sync succeeded: customers with key % 7 == 0."""
    c = table(spark, sf_dir, "customer").select("c_custkey").where(F.col("c_custkey") % 7 == 0)
    return c.select(F.floor(F.col("c_custkey") / 9).cast("int").alias("tenant_id")).distinct()


def setting_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants to report on: customer key div 8 (more than hold settings)."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.select(F.floor(F.col("c_custkey") / 8).cast("int").alias("tenant_id"))


BASE_MS = 1704067200000  # 2024-01-01T00:00:00Z


def token_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming token payloads (strings, as the auth service returns them), one
    per customer: tenant key % 100, realm key % 3."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    return c.select(
        (k % 100).cast("int").alias("tenant_id"),
        F.concat(F.lit("realm-"), (k % 3).cast("string")).alias("realm_id"),
        k.alias("seq"),
        F.concat(F.lit("st-"), k.cast("string")).alias("state"),
        F.when(k % 50 == 7, F.lit("n/a")).otherwise((k % 500).cast("string")).alias("latency"),
        F.concat(F.lit("idt-"), k.cast("string")).alias("id_token"),
        (F.lit(BASE_MS) + k * 60000).cast("string").alias("createdAt"),
        F.lit("3600").alias("expires_in"),
        F.lit("bearer").alias("token_type"),
        F.when(k % 97 != 5, F.concat(F.lit("at-"), k.cast("string"))).alias("access_token"),
        F.concat(F.lit("rt-"), k.cast("string")).alias("refresh_token"),
        (F.lit(86400) * (k % 120 + 1)).cast("string").alias("x_refresh_token_expires_in"),
        # Wall-clock (NTZ) timestamps: the same instant under any session time zone.
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(mins=(k % 1000).cast("int")))
        .alias("updated_at"),
    )


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens: accepted payloads upserted on (tenant, realm), last wins."""
    from tallyspark.operators.credentials import to_token_record
    from tallyspark.operators.upsert import dedupe_last
    from tallyspark.operators.validate import require
    p = token_payloads(spark, sf_dir)
    rec = to_token_record(p, keep=["tenant_id", "realm_id", "seq", "updated_at"])
    ok = require(rec, ["access_token", "refresh_token"]).where("accepted").drop("accepted", "reason")
    return dedupe_last(ok, ["tenant_id", "realm_id"], "seq").drop("seq")


def local_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local items to push: type by key % 4 (NULL when 3), price NULL when
    % 9 == 0, update of remote item k when even (of a missing one when
    % 10 == 4)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    return p.select(
        k.alias("item_id"),
        F.concat(F.col("p_name"), F.lit(" "), k.cast("string")).alias("name"),
        F.concat(F.lit("SKU-"), k.cast("string")).alias("sku"),
        F.col("p_type").alias("description"),
        F.when(k % 9 != 0, F.col("p_retailprice")).alias("price"),
        F.when(k % 4 == 0, F.lit("Inventory")).when(k % 4 == 1, F.lit("Service"))
        .when(k % 4 == 2, F.lit("NonInventory")).alias("type"),
        F.when(k % 3 == 0, F.col("p_size")).alias("qty_on_hand"),
        F.when(k % 10 == 4, k + 1000000000).when(k % 2 == 0, k).alias("qb_item_id"),
    )


def order_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entities-shaped table from orders with rule breaks: NULL tenant when
    key % 11 == 0, long phones (key % 60 chars) and addresses (key % 600)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.concat(F.lit("Order "), F.col("o_orderpriority")).alias("name"),
        F.repeat(F.lit("9"), (k % 60).cast("int")).alias("phone"),
        F.repeat(F.lit("x"), (k % 600).cast("int")).alias("address"),
        F.when(k % 11 != 0, (F.col("o_custkey") % 4).cast("int")).alias("tenant_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Customer"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("Vendor"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("Bank"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("Client")).alias("type"),
    )


def lineitem_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """skus from lineitem (no ratio / alert columns: the defaults apply)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("menu_item_id"),
                     (F.col("l_suppkey") % 4).cast("int").alias("tenant_id"),
                     F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string"), F.lit("-"),
                              F.col("l_suppkey").cast("string")).alias("sku"))


def part_menu_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                    F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 4).cast("int").alias("tenant_id"))


def _party_pages(docs: DataFrame, entity: str) -> DataFrame:
    """Documents as landed pages, one source per tenant ('<Entity>/<tenant>/<branch>', branch = tenant + 1): a whole
    run, 1000 a page by their place within the tenant, as a paged fetch gives them."""
    from tallyspark.operators.ids import assign_ids
    from tallyspark.sources.pages import pack_pages
    from tallyspark.streaming.incremental import source_path
    placed = assign_ids(docs, ["tenant_id", "pos"], id_col="_place")
    first = placed.groupBy("tenant_id").agg(F.min("_place").alias("_first"))
    placed = placed.join(first, "tenant_id").withColumn("pos", F.col("_place") - F.col("_first")).drop("_place", "_first")
    placed = placed.withColumn("_source", source_path(entity, F.col("tenant_id"), F.col("tenant_id") + 1))
    return pack_pages(placed.drop("tenant_id"), entity, order_col="pos", source=F.col("_source"))


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _party_pages(remote_customers(spark, sf_dir), "Customer")


def vendor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _party_pages(remote_vendors(spark, sf_dir), "Vendor")


def faulted_customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two later fetches that must change nothing: of tenant 0 one whose first page is a fault, of tenant 1 one whose
    first page never came.  Every record would be renamed."""
    from tallyspark.sources.pages import fault_body
    docs = remote_customers(spark, sf_dir).where("tenant_id < 2").withColumn("DisplayName", F.concat(F.lit("lost "), F.col("DisplayName")))
    pages = _party_pages(docs, "Customer").withColumn("fetch_seq", F.lit(9).cast("long"))
    fault = pages.where("source like 'Customer/0/%'").withColumn("body", F.when(F.col("requested_start") == 1, fault_body("Service unavailable")).otherwise(F.col("body")))
    gap = pages.where("source like 'Customer/1/%'").withColumn("requested_start", F.col("requested_start") + 1000)
    return fault.unionByName(gap)
