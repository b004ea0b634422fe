"""Serialised sync batches (S5, A4): a column holding a JSON array of sync
entities becomes one row per element with its position.

``from_json`` silently wraps a lone object into a one-element array, so the
array test comes first: ``json_array_length`` is NULL for anything that is not
an array, and such a batch fails the job (as the source procedure does).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import schemas as S

NOT_ARRAY = "A sync batch must be a JSON array."
NOT_OBJECT = "An element of a sync batch must be a JSON object."


def batch_length(c: Column) -> Column:
    """A4: number of elements; NULL (not an array) counts 0."""
    return F.coalesce(F.json_array_length(c), F.lit(0))


def _elements(df: DataFrame, c: Column, keep: list[str]) -> DataFrame:
    """One row per element, as its JSON text: one bad element does not take the others with it."""
    return df.select(*keep, F.posexplode(F.from_json(c, "array<string>")).alias("pos", "_t"))


def parse_sync_batch(df: DataFrame, json_col: str, keep: list[str] | None = None,
                     on_invalid: str = "fail") -> DataFrame:
    """Rows of (keep..., pos, name, email, phone, address, note, qb_id).

    ``on_invalid='fail'`` raises on a batch that is not a JSON array (NULL
    included) and on an element that is not an object; with ``'reject'`` those
    give no row here: ``sync_batch_rejects`` returns them.
    """
    keep = keep or []
    c = F.col(json_col)
    is_array = F.json_array_length(c).isNotNull()
    is_object = F.json_object_keys("_t").isNotNull()
    if on_invalid == "fail":
        checked = df.where(F.when(~is_array, F.raise_error(F.lit(NOT_ARRAY))).otherwise(F.lit(True)))
        ex = _elements(checked, c, keep).where(F.when(is_object, F.lit(True)).otherwise(F.raise_error(F.lit(NOT_OBJECT))))
    elif on_invalid == "reject":
        ex = _elements(df.where(is_array), c, keep).where(is_object)
    else:
        raise ValueError("on_invalid must be 'fail' or 'reject'")
    ex = ex.withColumn("_e", F.from_json("_t", S.SYNC_ENTITY_DDL))
    return ex.select(*keep, F.col("pos").cast("long").alias("pos"),
                     *[F.col("_e")[f].alias(f) for f in ("name", "email", "phone", "address", "note")],
                     F.col("_e.qbId").alias("qb_id"))


def sync_batch_rejects(df: DataFrame, json_col: str, keep: list[str] | None = None) -> DataFrame:
    """What ``parse_sync_batch(on_invalid='reject')`` leaves out: (keep..., pos, value, reason); pos is NULL for a whole batch."""
    keep, c = keep or [], F.col(json_col)
    is_array = F.json_array_length(c).isNotNull()
    whole = df.where(~is_array).select(*keep, F.lit(None).cast("long").alias("pos"), c.alias("value"), F.lit(NOT_ARRAY).alias("reason"))
    parts = _elements(df.where(is_array), c, keep).where(F.json_object_keys("_t").isNull())
    return whole.unionByName(parts.select(*keep, F.col("pos").cast("long").alias("pos"), F.col("_t").alias("value"), F.lit(NOT_OBJECT).alias("reason")))


def to_sync_batch(rows: DataFrame, group_cols: list[str], order_col: str) -> DataFrame:
    """Serialise rows (name, email, phone, address, note, qb_id) into one JSON
    array per group, in ``order_col`` order.  Groups must be bounded (e.g. a
    chunk of positions): the whole group becomes one value."""
    elem = F.struct(F.col(order_col).alias("_o"), F.struct(
        "name", "email", "phone", "address", "note", F.col("qb_id").alias("qbId")).alias("_e"))
    g = rows.groupBy(*group_cols).agg(F.sort_array(F.collect_list(elem)).alias("_a"))
    return g.select(*group_cols, F.to_json(F.transform("_a", lambda x: x["_e"])).alias("json_data"))
