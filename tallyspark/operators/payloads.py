"""Outbound item payloads (P17) with the version lookup for updates.

Rows of ``items`` (name, sku, description, price, type, qty_on_hand,
qb_item_id, ...) become the JSON bodies the remote item endpoint takes.
Defaults: price 0, type 'Inventory', quantity 0 (a NULL counts as absent --
a chosen divergence: the source applies defaults to absent keys only).
Inventory items add expense/asset refs, TrackQtyOnHand, QtyOnHand and
InvStartDate (the UTC date, passed in so runs repeat).  Updates carry Id (as a
string) and the current SyncToken; an update whose current record is missing
is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import schemas as S


@dataclass
class PayloadResult:
    payloads: DataFrame
    rejects: DataFrame


def _ref(v):
    return F.struct(F.lit(v[0]).alias("value"), F.lit(v[1]).alias("name"))


def attach_version(updates: DataFrame, current: DataFrame, id_col: str = "qb_item_id", by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """SyncToken of the current record of the same (by..., Id) for every update; no current record
    -> reject 'Unable to fetch the existing remote item for its SyncToken.'

    ``by`` names the tenant columns, which both sides hold: ids repeat across tenants.  Of records that repeat an id
    the one with the highest token (as a number) counts."""
    by = by or []
    token = F.struct(F.expr("try_cast(SyncToken as bigint)").alias("n"), F.col("SyncToken").alias("t"))
    cur = current.groupBy(*by, F.col("Id").cast("string").alias("_cid")).agg(F.max(token).alias("_v"), F.lit(True).alias("_found"))
    cur = cur.select(*by, "_cid", F.col("_v.t").alias("sync_token"), "_found")
    j = updates.withColumn("_cid", F.col(id_col).cast("string")).join(cur, [*by, "_cid"], "left").drop("_cid")
    ok = j.where(F.col("_found").isNotNull()).drop("_found")
    bad = j.where(F.col("_found").isNull()).drop("_found", "sync_token").withColumn(
        "reason", F.lit("Unable to fetch the existing remote item for its SyncToken."))
    return ok, bad


def build_item_payload(items: DataFrame, current: DataFrame, as_of_date: str,
                       income_ref=S.INCOME_ACCOUNT_REF, expense_ref=S.EXPENSE_ACCOUNT_REF,
                       asset_ref=S.ASSET_ACCOUNT_REF, keep: list[str] | None = None,
                       by: list[str] | None = None) -> PayloadResult:
    """``by``: the tenant columns of items and current; ``keep``: further columns to carry.  A NULL, blank or 0 remote
    id is a create."""
    by = by or []
    keep = [*by, *(keep or [])]
    typ = F.coalesce(F.col("type"), F.lit("Inventory"))
    inv = typ == F.lit("Inventory")
    base = items.select(*keep, "name", "sku", "description", F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"),
                        typ.alias("type"), F.coalesce(F.col("qty_on_hand").cast("double"), F.lit(0.0)).alias("qty"),
                        F.when(~F.trim(F.col("qb_item_id").cast("string")).isin("", "0"), F.col("qb_item_id")).alias("qb_item_id"), inv.alias("_inv"))
    creates = base.where(F.col("qb_item_id").isNull()).withColumn("sync_token", F.lit(None).cast("string"))
    updates, rejects = attach_version(base.where(F.col("qb_item_id").isNotNull()), current, by=by)
    rows = creates.unionByName(updates)
    body = F.struct(
        F.col("name").alias("Name"), F.col("type").alias("Type"), F.col("sku").alias("Sku"),
        F.col("description").alias("Description"), F.col("price").alias("UnitPrice"),
        _ref(income_ref).alias("IncomeAccountRef"),
        F.when(F.col("_inv"), _ref(expense_ref)).alias("ExpenseAccountRef"),
        F.when(F.col("_inv"), _ref(asset_ref)).alias("AssetAccountRef"),
        F.when(F.col("_inv"), F.lit(True)).alias("TrackQtyOnHand"),
        F.when(F.col("_inv"), F.col("qty")).alias("QtyOnHand"),
        F.when(F.col("_inv"), F.lit(as_of_date)).alias("InvStartDate"),
        F.col("qb_item_id").cast("string").alias("Id"),
        F.col("sync_token").alias("SyncToken"),
    )
    out = rows.withColumn("body", body).withColumn("payload", F.to_json("body"))
    return PayloadResult(out.drop("_inv"), rejects.drop("_inv"))
