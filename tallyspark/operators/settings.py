"""Settings: defaults upsert with the tax-code fan-out (U4, U9), sync markers
(U8) and the coverage report of expected keys (J6).

The source table is global (no tenant column); every function here takes
``by`` (e.g. ['tenant_id']) so the same code serves one global settings table
or one per tenant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.operators.ids import assign_ids, next_id
from tallyspark.operators.upsert import upsert


def fan_out_tax_rate(saves: DataFrame) -> DataFrame:
    """Saving 'tax_code' also saves 'tax_rate_ref' (its first tax-rate ref)
    right after it.  ``saves``: by..., name, qb_id, qb_name, tax_rate_ref_id,
    seq.  Output adds ``sub`` (0 for the save itself, 1 for the fan-out)."""
    other = [c for c in saves.columns if c not in ("name", "qb_id", "qb_name", "tax_rate_ref_id", "seq")]
    me = F.struct(F.col("name"), F.col("qb_id"), F.col("qb_name"), F.lit(0).alias("sub"))
    extra = F.struct(F.lit(S.TAX_RATE_REF_KEY).alias("name"), F.col("tax_rate_ref_id").alias("qb_id"),
                     F.lit(S.TAX_RATE_REF_LABEL).alias("qb_name"), F.lit(1).alias("sub"))
    arr = F.when(F.col("name") == F.lit("tax_code"), F.array(me, extra)).otherwise(F.array(me))
    return saves.select(*other, "seq", F.explode(arr).alias("_s")).select(*other, "seq", "_s.*")


def sync_markers(done: DataFrame, marker: str, seq) -> DataFrame:
    """U8: ('customers_synced' | 'vendors_synced', '1', 'Synced') for every
    row of ``done`` (e.g. the tenants whose sync succeeded)."""
    if marker not in S.SYNC_MARKER_KEYS:
        raise ValueError(f"unknown marker {marker}")
    return done.select(*done.columns, F.lit(marker).alias("name"), F.lit(S.SYNCED_VALUE).alias("qb_id"),
                       F.lit(S.SYNCED_LABEL).alias("qb_name"), F.lit(seq).cast("long").alias("seq"),
                       F.lit(0).alias("sub"))


def _blank(c: str):
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == F.lit("")


def nameless(saves: DataFrame) -> DataFrame:
    """Saves that ``save_defaults`` refuses: the name is required."""
    return saves.where(_blank("name")).withColumn("reason", F.lit("Name is required"))


def save_defaults(target: DataFrame, saves: DataFrame, by: list[str] | None = None, reserve=None) -> DataFrame:
    """U4 on (by..., name): QB_ID and QB_Name replaced, last save wins (by seq,
    then sub).  A save without a name is refused (F5): see ``nameless``.

    A target with an ``id`` column numbers its new rows (auto-increment): on from the largest id, in the order of their
    keys, or from what ``reserve`` (told how many) gives.  An updated row keeps its id."""
    keys = [*(by or []), "name"]
    saves = saves.where(~_blank("name"))
    src = saves.withColumn("_ord", F.struct("seq", "sub")).select(*keys, "qb_id", "qb_name", "_ord")
    tgt_cols = [c for c in target.columns]
    out = upsert(target.select(*tgt_cols), src.select(*keys, "qb_id", "qb_name", "_ord"), keys,
                 ["qb_id", "qb_name"], order_col="_ord")
    if "id" not in target.columns:
        return out
    # A saved row always has an id, so those without one are new.
    fresh = assign_ids(out.where(F.col("id").isNull()).drop("id"), keys, start=reserve or (lambda n: next_id(target)))
    return out.where(F.col("id").isNotNull()).unionByName(fresh.withColumn("id", F.col("id").cast(target.schema["id"].dataType)))


def defaults_coverage(scopes: DataFrame, saved: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every expected setting key (and sync marker) per scope row, joined to
    the saved row: status 'assigned' (a row exists) / 'Unassigned' for
    settings, 'Synced' / 'Not synced' for markers (QB_ID = '1').  Keys are generated per scope with
    ``explode`` (no cross join); the saved table is joined on (by..., name)."""
    by = by or []
    keys = F.array(*[F.struct(F.lit(k).alias("name"), F.lit("setting").alias("kind")) for k in S.SETTING_KEYS],
                   *[F.struct(F.lit(k).alias("name"), F.lit("marker").alias("kind")) for k in S.SYNC_MARKER_KEYS])
    expected = scopes.select(*by).distinct().select(*by, F.explode(keys).alias("_k")).select(*by, "_k.*")
    j = expected.join(saved.select(*by, "name", "qb_id", "qb_name", F.lit(True).alias("_saved")), [*by, "name"], "left")
    # A saved row makes the setting assigned, whatever its values.
    setting_status = F.when(F.col("_saved"), F.lit("assigned")).otherwise(F.lit("Unassigned"))
    marker_status = F.when(F.col("qb_id") == F.lit(S.SYNCED_VALUE), F.lit("Synced")).otherwise(F.lit("Not synced"))
    status = F.when(F.col("kind") == "marker", marker_status).otherwise(setting_status)
    return j.select(*by, "name", "kind", status.alias("status"), "qb_id", "qb_name")
