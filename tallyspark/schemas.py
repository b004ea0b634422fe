"""Schemas of the remote documents and the local tables, plus the table rules
(keys, not-null, lengths, domains, defaults, references) that drive the audits.

Remote documents have an open schema: optional keys are simply absent.  We
always read them with an explicit schema so an all-absent field still exists
as a NULL column, and ids/sync tokens stay strings.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType, TimestampType)

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the source system's values for results to
# match, so they are stated here as plain text, in their natural order.
# ---------------------------------------------------------------------------

# Seeded entity types, in seed order (ids 1..7 follow this order).
ENTITY_TYPE_NAMES = ["Customer", "Vendor", "Bank", "Shareholder", "Tax", "Internal", "Fixed Asset"]

# Setting keys shown on the defaults page, in page order.
SETTING_KEYS = [
    "walk_in_customer",
    "payable_account",
    "receivable_account",
    "tax_code",
    "card_control_account",
    "cash_account",
    "cash_payment_method",
    "card_payment_method",
    "delivery_fee",
]
# Sync markers and the value that means "synced".
SYNC_MARKER_KEYS = ["customers_synced", "vendors_synced"]
SYNCED_VALUE = "1"
SYNCED_LABEL = "Synced"
# Extra setting written whenever tax_code is saved.
TAX_RATE_REF_KEY = "tax_rate_ref"
TAX_RATE_REF_LABEL = "Tax Rate Ref"

# Remote page size used by the paged fetch.
PAGE_SIZE = 1000
# Rows returned by one search.
SEARCH_LIMIT = 50
# Item types accepted by the item payload.
ITEM_TYPES = ["Inventory", "Service", "NonInventory"]
# Placeholder account references used by the item payload (parameters of
# build_item_payload; these are the defaults).
INCOME_ACCOUNT_REF = ("79", "Sales of Product Income")
EXPENSE_ACCOUNT_REF = ("80", "Cost of Goods Sold")
ASSET_ACCOUNT_REF = ("81", "Inventory Asset")

# ---------------------------------------------------------------------------
# Remote documents
# ---------------------------------------------------------------------------

REF = StructType([StructField("value", StringType()), StructField("name", StringType())])

PARTY_DOC = StructType([
    StructField("Id", StringType()),
    StructField("DisplayName", StringType()),
    StructField("GivenName", StringType()),
    StructField("CompanyName", StringType()),
    StructField("PrimaryEmailAddr", StructType([StructField("Address", StringType())])),
    StructField("PrimaryPhone", StructType([StructField("FreeFormNumber", StringType())])),
    StructField("BillAddr", StructType([
        StructField("Line1", StringType()),
        StructField("City", StringType()),
        StructField("CountrySubDivisionCode", StringType()),
    ])),
])
CUSTOMER_DOC = PARTY_DOC
VENDOR_DOC = PARTY_DOC

ITEM_DOC = StructType([
    StructField("Id", StringType()),
    StructField("SyncToken", StringType()),
    StructField("Name", StringType()),
    StructField("Description", StringType()),
    StructField("Active", BooleanType()),
    StructField("FullyQualifiedName", StringType()),
    StructField("Taxable", BooleanType()),
    StructField("UnitPrice", DoubleType()),
    StructField("Type", StringType()),
    StructField("IncomeAccountRef", REF),
    StructField("PurchaseDesc", StringType()),
    StructField("PurchaseCost", DoubleType()),
    StructField("ExpenseAccountRef", REF),
    StructField("AssetAccountRef", REF),
    StructField("TrackQtyOnHand", BooleanType()),
    StructField("QtyOnHand", LongType()),
    StructField("InvStartDate", StringType()),
    StructField("Sku", StringType()),
    StructField("domain", StringType()),
    StructField("sparse", BooleanType()),
    StructField("MetaData", StructType([
        StructField("CreateTime", StringType()),
        StructField("LastUpdatedTime", StringType()),
    ])),
    # Items carry no DisplayName / CompanyName; kept nullable so the mapping
    # row (P11) can address them on every entity.
    StructField("DisplayName", StringType()),
    StructField("CompanyName", StringType()),
])

ACCOUNT_DOC = StructType([
    StructField("Id", StringType()), StructField("Name", StringType()), StructField("AccountType", StringType()),
])
PAYMENT_METHOD_DOC = StructType([
    StructField("Id", StringType()), StructField("Name", StringType()), StructField("Type", StringType()),
])
TAX_CODE_DOC = StructType([
    StructField("Id", StringType()),
    StructField("Name", StringType()),
    StructField("SalesTaxRateList", StructType([
        StructField("TaxRateDetail", ArrayType(StructType([
            StructField("TaxRateRef", StructType([StructField("value", StringType())])),
        ]))),
    ])),
])
COMPANY_INFO_DOC = StructType([
    StructField("Id", StringType()),
    StructField("CompanyName", StringType()),
    StructField("LegalName", StringType()),
    StructField("CompanyAddr", StructType([
        StructField("Line1", StringType()),
        StructField("Line2", StringType()),
        StructField("City", StringType()),
        StructField("CountrySubDivisionCode", StringType()),
        StructField("PostalCode", StringType()),
        StructField("Country", StringType()),
    ])),
])

ENTITY_DOCS = {
    "Customer": CUSTOMER_DOC,
    "Vendor": VENDOR_DOC,
    "Item": ITEM_DOC,
    "Account": ACCOUNT_DOC,
    "PaymentMethod": PAYMENT_METHOD_DOC,
    "TaxCode": TAX_CODE_DOC,
    "CompanyInfo": COMPANY_INFO_DOC,
}


def page_schema(entity: str, record: StructType | None = None) -> StructType:
    """Schema of one query-response page.  ``Fault`` is kept as raw JSON text."""
    record = record or ENTITY_DOCS[entity]
    return StructType([
        StructField("QueryResponse", StructType([
            StructField(entity, ArrayType(record)),
            StructField("startPosition", LongType()),
            StructField("maxResults", LongType()),
        ])),
        StructField("Fault", StringType()),
        StructField("time", StringType()),
    ])


# Element of the serialised sync batch.
SYNC_ENTITY = StructType([
    StructField("name", StringType()),
    StructField("email", StringType()),
    StructField("phone", StringType()),
    StructField("address", StringType()),
    StructField("note", StringType()),
    StructField("qbId", StringType()),
])
SYNC_ENTITY_DDL = "name string, email string, phone string, address string, note string, qbId string"

# Incoming token payload.
TOKEN_DOC = StructType([
    StructField("state", StringType()),
    StructField("latency", StringType()),
    StructField("id_token", StringType()),
    StructField("createdAt", StringType()),
    StructField("expires_in", StringType()),
    StructField("token_type", StringType()),
    StructField("access_token", StringType()),
    StructField("refresh_token", StringType()),
    StructField("x_refresh_token_expires_in", StringType()),
])

# ---------------------------------------------------------------------------
# Local tables.  Ids are 64-bit: a 32-bit auto-increment runs out at scale.
# ---------------------------------------------------------------------------

ENTITIES = StructType([
    StructField("id", LongType()),
    StructField("name", StringType()),
    StructField("email", StringType()),
    StructField("phone", StringType()),
    StructField("note", StringType()),
    StructField("type", StringType()),
    StructField("qb_id", StringType()),
    StructField("tenant_id", IntegerType()),
    StructField("is_intrinsic", BooleanType()),
    StructField("ntn", IntegerType()),
    StructField("address", StringType()),
])
ENTITY_COLUMNS = [f.name for f in ENTITIES.fields]

BRANCHES = StructType([
    StructField("id", IntegerType()), StructField("tenant_id", IntegerType()), StructField("name", StringType()),
])
ENTITY_TYPES = StructType([StructField("id", IntegerType()), StructField("name", StringType())])
ENTITY_ASSIGNMENTS = StructType([
    StructField("id", LongType()), StructField("entity", LongType()),
    StructField("type", IntegerType()), StructField("tenant_id", IntegerType()),
])
ENTITY_BRANCH_ASSIGNMENTS = StructType([
    StructField("entity_id", LongType()), StructField("branch_id", IntegerType()),
])
QB_DEFAULTS = StructType([
    StructField("id", LongType()), StructField("name", StringType()),
    StructField("qb_id", StringType()), StructField("qb_name", StringType()),
])
MENU_CATEGORIES = StructType([
    StructField("id", LongType()), StructField("name", StringType()),
    StructField("is_deal", BooleanType()), StructField("tenant_id", IntegerType()),
])
MENU_ITEMS = StructType([
    StructField("id", LongType()), StructField("name", StringType()), StructField("qb_id", StringType()),
    StructField("price", DoubleType()), StructField("category", LongType()),
    StructField("image_url", StringType()), StructField("tenant_id", IntegerType()),
])
SKUS = StructType([
    StructField("id", LongType()), StructField("menu_item_id", LongType()), StructField("qb_id", StringType()),
    StructField("tenant_id", IntegerType()), StructField("sku", StringType()),
    StructField("ratio", DoubleType()), StructField("alert_threshold", DoubleType()),
])
TOKENS = StructType([
    StructField("tenant_id", IntegerType()),
    StructField("realm_id", StringType()),
    StructField("state", StringType()),
    StructField("latency", IntegerType()),
    StructField("id_token", BinaryType()),
    StructField("created_at", LongType()),
    StructField("expires_in", IntegerType()),
    StructField("token_type", StringType()),
    StructField("access_token", BinaryType()),
    StructField("refresh_token", BinaryType()),
    StructField("x_refresh_token_expires_in", IntegerType()),
    StructField("updated_at", TimestampType()),
])


@dataclass(frozen=True)
class TableRules:
    """Integrity rules of one table, as the source DDL declares them."""

    name: str
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    lengths: dict = field(default_factory=dict)
    domains: dict = field(default_factory=dict)
    defaults: dict = field(default_factory=dict)
    # (columns, parent table, parent columns)
    references: tuple = ()


RULES = {
    "tokens": TableRules(
        "tokens", primary_key=("tenant_id", "realm_id"),
        not_null=("tenant_id", "realm_id", "access_token", "refresh_token", "updated_at"),
        lengths={"realm_id": 64, "state": 255, "token_type": 50}),
    "qb_defaults": TableRules(
        "qb_defaults", primary_key=("id",), unique=(("name",),), not_null=("id", "name"),
        lengths={"name": 250, "qb_id": 100, "qb_name": 500}),
    "branches": TableRules(
        "branches", primary_key=("id", "tenant_id"), not_null=("id", "tenant_id"), lengths={"name": 250}),
    "entities": TableRules(
        "entities", primary_key=("id", "tenant_id"), unique=(("name", "tenant_id"),),
        not_null=("id", "tenant_id"),
        lengths={"name": 250, "email": 250, "phone": 50, "type": 100, "qb_id": 100, "address": 500},
        defaults={"tenant_id": 1, "is_intrinsic": False}),
    "entity_branch_assignments": TableRules(
        "entity_branch_assignments", primary_key=("entity_id", "branch_id"),
        not_null=("entity_id", "branch_id"),
        references=((("entity_id",), "entities", ("id",)), (("branch_id",), "branches", ("id",)))),
    "entity_types": TableRules(
        "entity_types", primary_key=("id",), not_null=("id",), domains={"name": tuple(ENTITY_TYPE_NAMES)}),
    "entity_assignments": TableRules(
        "entity_assignments", primary_key=("id", "tenant_id"), not_null=("id", "tenant_id"),
        defaults={"tenant_id": 1},
        references=((("entity",), "entities", ("id",)), (("type",), "entity_types", ("id",)))),
    "menu_categories": TableRules(
        "menu_categories", primary_key=("id", "tenant_id"), not_null=("id", "tenant_id"),
        lengths={"name": 500}, defaults={"tenant_id": 1, "is_deal": False}),
    "menu_items": TableRules(
        "menu_items", primary_key=("id", "tenant_id"), not_null=("id", "tenant_id"),
        lengths={"name": 500, "qb_id": 100}, defaults={"tenant_id": 1},
        references=((("category", "tenant_id"), "menu_categories", ("id", "tenant_id")),)),
    "skus": TableRules(
        "skus", primary_key=("id", "tenant_id"), unique=(("sku", "tenant_id"),),
        not_null=("id", "tenant_id", "sku", "ratio", "alert_threshold"), lengths={"qb_id": 100, "sku": 50},
        defaults={"ratio": 1.0, "alert_threshold": 5.0},
        references=((("menu_item_id", "tenant_id"), "menu_items", ("id", "tenant_id")),)),
}
