"""Bulk mapping-id update (U7, J7) with the mapping action label.

Instructions (internal_id, external_id, type, tenant_id, seq) are checked
for required fields (F5), routed by type -- Customer/Vendor to entities,
MenuItem/Item to skus, anything else changes nothing -- deduplicated (last
``seq`` wins per target row) and applied with a left join.

Divergences from the source system, by design: the update joins on the tenant
too (the source update has no tenant predicate although keys are
(ID, Tenant_ID)); and the entity's type can be resolved through
entity_assignments (``type_source='assignment'``, default), since a synced
entity never gets ``entities.type`` filled and could otherwise never be
re-mapped.  ``type_source='column'`` gives the source behaviour.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.validate import require

ENTITY_TYPES_ROUTED = ["Customer", "Vendor"]
SKU_TYPES_ROUTED = ["MenuItem", "Item"]
REQUIRED = ["internal_id", "external_id", "type"]


@dataclass
class MappingResult:
    entities: DataFrame
    skus: DataFrame
    applied: DataFrame   # (target_table, id, tenant_id, old_qb_id, new_qb_id)
    rejects: DataFrame   # instructions missing a field, with reason
    stats: DataFrame     # per route: instructions, matched, unmatched


def _last(df: DataFrame, keys: list[str]) -> DataFrame:
    w = df.groupBy(*keys).agg(F.max(F.struct("seq", "external_id")).alias("_w"))
    return w.select(*keys, F.col("_w.external_id").alias("new_qb_id"))


def apply_mappings(entities: DataFrame, skus: DataFrame, mappings: DataFrame, *,
                   assignments: DataFrame | None = None, types: DataFrame | None = None,
                   type_source: str = "assignment") -> MappingResult:
    checked = require(mappings, REQUIRED)
    good = checked.where("accepted").drop("accepted", "reason")
    rejects = checked.where("NOT accepted").drop("accepted")
    good = good.withColumn("internal_id", F.col("internal_id").cast("long"))

    # Entities: match on (id, tenant) and on the entity's type.
    ent_ins = good.where(F.col("type").isin(ENTITY_TYPES_ROUTED))
    if type_source == "column":
        ent_types = entities.select(F.col("id").alias("internal_id"), "tenant_id", "type")
    elif type_source == "assignment":
        if assignments is None or types is None:
            raise ValueError("type_source='assignment' needs assignments and types")
        # A plain join: AQE broadcasts the caller's types after measuring them.
        ent_types = (assignments.join(types.select(F.col("id").alias("type"), F.col("name").alias("_tn")), "type")
                     .select(F.col("entity").alias("internal_id"), "tenant_id", F.col("_tn").alias("type")))
    else:
        raise ValueError("type_source must be 'assignment' or 'column'")
    # A semi join needs no distinct right side (that would shuffle the whole
    # assignments table); the small instruction side can be broadcast by AQE.
    ent_hit = ent_ins.join(ent_types, ["internal_id", "tenant_id", "type"], "left_semi")
    ent_new = _last(ent_hit, ["internal_id", "tenant_id"])
    e = entities.join(ent_new.withColumnRenamed("internal_id", "id"), ["id", "tenant_id"], "left")
    entities_out = e.select(*[F.coalesce(F.col("new_qb_id"), F.col("qb_id")).alias("qb_id") if c == "qb_id"
                              else F.col(c) for c in entities.columns])
    ent_applied = e.where(F.col("new_qb_id").isNotNull()).select(
        F.lit("entities").alias("target_table"), "id", "tenant_id", F.col("qb_id").alias("old_qb_id"), "new_qb_id")

    # Skus: match on (id, tenant).
    sku_ins = good.where(F.col("type").isin(SKU_TYPES_ROUTED))
    sku_hit = sku_ins.join(skus.select(F.col("id").alias("internal_id"), "tenant_id"),
                           ["internal_id", "tenant_id"], "left_semi")
    sku_new = _last(sku_hit, ["internal_id", "tenant_id"])
    s = skus.join(sku_new.withColumnRenamed("internal_id", "id"), ["id", "tenant_id"], "left")
    skus_out = s.select(*[F.coalesce(F.col("new_qb_id"), F.col("qb_id")).alias("qb_id") if c == "qb_id"
                          else F.col(c) for c in skus.columns])
    sku_applied = s.where(F.col("new_qb_id").isNotNull()).select(
        F.lit("skus").alias("target_table"), "id", "tenant_id", F.col("qb_id").alias("old_qb_id"), "new_qb_id")

    route = (F.when(F.col("type").isin(ENTITY_TYPES_ROUTED), F.lit("entities"))
             .when(F.col("type").isin(SKU_TYPES_ROUTED), F.lit("skus")).otherwise(F.lit("none")))
    hits = (ent_hit.select("internal_id", "tenant_id", "type", "seq")
            .unionByName(sku_hit.select("internal_id", "tenant_id", "type", "seq"))
            .withColumn("_hit", F.lit(True)))
    stats = (good.join(hits, ["internal_id", "tenant_id", "type", "seq"], "left")
             .groupBy(route.alias("route"))
             .agg(F.count(F.lit(1)).alias("instructions"), F.count_if(F.col("_hit").isNotNull()).alias("matched"))
             .withColumn("unmatched", F.col("instructions") - F.col("matched")))
    return MappingResult(entities_out, skus_out, ent_applied.unionByName(sku_applied), rejects, stats)


def _located(spark, root: str, state, stage: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current rows, their partition keys) of the partitions that hold the given (id, tenant_id).

    A row's bucket follows its external id, which an instruction does not carry, so the (tenant, bucket, id) columns of
    the touched tenants are scanned to find it (column-pruned, no other column is read)."""
    from tallyspark.sources.tables import read_data, restrict_partitions, save_keys
    data = read_data(spark, root)
    keys = save_keys(ids, f"{stage}/tenants", ["tenant_id"])
    parts = ["tenant_id"]
    if state.buckets:
        parts = ["tenant_id", "bucket"]
        found = restrict_partitions(data, keys, ["tenant_id"]).select("tenant_id", "bucket", "id").join(ids, ["id", "tenant_id"], "left_semi")
        keys = save_keys(found, f"{stage}/keys", parts)
    return restrict_partitions(data, keys, parts), keys


def _stage_remapped(spark, root: str, state, stage: str, out: DataFrame, keys: DataFrame) -> None:
    """The rewritten partitions, and the list of those that have lost their last row."""
    from tallyspark.sources.tables import entity_bucket, gathered, read_data, restrict_partitions, save_keys
    parts = ["tenant_id"]
    if state.buckets:
        parts = ["tenant_id", "bucket"]
        out = out.withColumn("bucket", entity_bucket(state.buckets))
        # Rows moving to a bucket not read yet bring that bucket's rows along.
        new = save_keys(restrict_partitions(out.select(*parts), keys, parts, negate=True), f"{stage}/extra", parts)
        out = out.unionByName(restrict_partitions(read_data(spark, root), new, parts).select(*out.columns))
    gathered(out, parts).write.mode("overwrite").partitionBy(*parts).parquet(f"{stage}/rows")
    left = spark.read.schema(out.schema).parquet(f"{stage}/rows").select(*parts).distinct()
    restrict_partitions(keys, left, parts, negate=True).write.mode("overwrite").parquet(f"{stage}/emptied")


def apply_mappings_into_table(spark, mappings: DataFrame, table_root: str, skus: DataFrame | None = None, *, skus_root: str | None = None,
                              stream: str = "mapping", batch_id: int | None = None, lease: float | None = None, **kw) -> MappingResult:
    """U7 against partitioned tables (sources.tables): the entities at ``table_root`` and, with ``skus_root``, the skus there
    (both by ``init_partitioned``).  Only the partitions holding a mapped row -- and, on a bucketed table, the buckets its
    new external id moves it to -- are read and rewritten.

    Each table's change is staged, declared and closed as in the sync (sources.commits), so a stop between any two steps
    leaves neither two copies nor none of a row: the next writer closes it.  ``batch_id`` makes a replay harmless; without
    one each call is a batch of its own.  Returns the reports (kept beside the entities table) and the new tables; skus
    that are only handed over as a frame are mapped in the returned frame and written nowhere."""
    from tallyspark.sources import commits as C
    from tallyspark.sources.tables import read_data
    lease = C.LEASE if lease is None else lease
    root, also = table_root.rstrip("/"), skus_root.rstrip("/") if skus_root else None
    if also is None and skus is None:
        raise ValueError("skus (a frame) or skus_root (a table) is needed")
    if batch_id is None:
        batch_id = C.load(spark, root).last(stream) + 1
    side = f"{root}/_side/{{}}/stream={C.folder_name(stream)}/batch_id={batch_id}"
    ids = mappings.select(F.col("internal_id").try_cast("long").alias("id"), "tenant_id").distinct()

    def attempt(table: str, frames) -> None:
        """Stage and commit one table; again from the start if another writer was first."""
        while True:
            C.settle_pending(spark, table, stream, lease)
            state = C.load(spark, table)
            if state.last(stream) >= batch_id:
                return
            stage = C.stage_path(table, stream, batch_id, state.version)
            if not C.is_staged(spark, stage):
                current, keys = _located(spark, table, state, stage, ids)
                _stage_remapped(spark, table, state, stage, frames(current.drop("bucket") if state.buckets else current), keys)
                C.mark_staged(spark, stage)
            try:
                return C.commit_stage(spark, table, stream, batch_id, state.version, stage, ["tenant_id"] + (["bucket"] if state.buckets else []))
            except C.Conflict:
                C.drop_stage(spark, stage)

    def sku_rows() -> DataFrame:
        return skus if also is None else read_data(spark, also).drop("bucket")

    def entities_of(current: DataFrame) -> DataFrame:
        found = apply_mappings(current, sku_rows(), mappings, **kw)
        # Reports are written before the change: they tell the external ids from before.
        for name, df in (("mapping_applied", found.applied), ("mapping_rejects", found.rejects), ("mapping_stats", found.stats)):
            df.write.mode("overwrite").parquet(side.format(name))
        return found.entities

    with C.one_at_a_time(root):
        attempt(root, entities_of)
    if also is not None:
        with C.one_at_a_time(also):
            attempt(also, lambda current: apply_mappings(read_data(spark, root).drop("bucket").limit(0), current, mappings, **kw).skus)
    new_skus = read_data(spark, also) if also is not None else apply_mappings(read_data(spark, root).drop("bucket").limit(0), skus, mappings, **kw).skus
    reports = [spark.read.parquet(side.format(n)) for n in ("mapping_applied", "mapping_rejects", "mapping_stats")]
    return MappingResult(read_data(spark, root), new_skus, *reports)
