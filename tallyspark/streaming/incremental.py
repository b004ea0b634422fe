"""Incremental sync (T1): landed pages are upserted as their runs become whole.

In place of a queued background job (own process, three attempts, a time limit),
a Structured Streaming query reads new landed-page files.  Its completeness gate
(``streaming.gate``) holds the descriptors of a run's pages until the run is
whole and free of faults; ``foreachBatch`` then applies the released runs:
explode -> normalise -> upsert -> commit of the touched partitions.

* Several streams (customers, vendors, ...) write one table.  The last applied
  batch is kept per stream, where a stream is an entity and a query id; staging
  and side folders carry its name; a commit is a compare-and-set on the table's
  state (``sources.commits``).  A batch whose stage was made before another
  stream's commit is computed again on the newer table.
* Ids come from a block that the writer reserves in the state before it stages.
* Each attempt at a batch is counted before it begins.  After ``max_attempts``
  failures the batch's pages go to the quarantine table and the stream goes on.
* A run that was applied writes its marker (U8) into the table's settings, also
  a run without rows; one with a fault or a gap applies nothing and marks nothing.

Only the touched tenants (and, on a bucketed table, buckets) are read and
rewritten; their keys are a written table whose join prunes the scan.  Replays
are harmless: an applied batch is skipped, a declared commit is closed from its
stage, side outputs are overwritten.  A landed page's ``source`` is
``<Entity>/<tenant_id>/<branch_id>`` (the job payload of the source system).
"""

from __future__ import annotations

import threading
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.operators.normalize import normalize_party
from tallyspark.operators.settings import save_defaults, sync_markers
from tallyspark.operators.upsert import upsert_entities
from tallyspark.sources import commits as C
from tallyspark.sources.pages import LANDED_PAGE, explode_pages, split_faults
from tallyspark.sources.tables import (bucket_of, commit_table, current_pointer, entity_bucket, gathered, read_data, read_table, restrict_partitions,
                                       save_keys)
from tallyspark.streaming.gate import RELEASED, gate, read_released, whole_runs

MARKERS = {"Customer": "customers_synced", "Vendor": "vendors_synced"}
SETTINGS = "id long, tenant_id int, name string, qb_id string, qb_name string"
MAX_ATTEMPTS, PAUSE = 3, 1.0
#: State stores of the gate: it holds some 100 bytes a page, not the pages.
GATE_PARTITIONS = 16
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source_path(entity: str, tenant_id, branch_id):
    return F.concat_ws("/", F.lit(entity), tenant_id.cast("string"), branch_id.cast("string"))


def source_parts(pages: DataFrame) -> DataFrame:
    """Adds tenant_id and branch_id of a source; an absent branch is branch 1."""
    parts = F.split(F.col("source"), "/")
    return (pages.withColumn("tenant_id", F.try_element_at(parts, F.lit(2)).try_cast("int"))
            .withColumn("branch_id", F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("int"), F.lit(1))))


def _wrong_source(entity: str):
    """Why a page (with ``source_parts``) cannot belong to a run of this entity."""
    return (F.when(~(F.get(F.split(F.col("source"), "/"), F.lit(0)).eqNullSafe(F.lit(entity))), F.lit("Page of another entity"))
            .when(F.col("tenant_id").isNull(), F.lit("Page without a tenant")))


def landed_rows(pages: DataFrame, batch_id: int, entity: str = "Customer") -> tuple[DataFrame, DataFrame]:
    """Landed pages -> (sync batch rows, fault pages).

    A page of another entity, or without a tenant in its source, is a fault too; an absent branch is branch 1.  A
    page's ``fetch_seq`` orders its rows before their positions, so of two landings of a page the later one holds."""
    if "fetch_seq" not in pages.columns:
        pages = pages.withColumn("fetch_seq", F.lit(None).cast("long"))
    pages = source_parts(pages).withColumn("seq", F.coalesce("fetch_seq", F.lit(0).cast("long")))
    wrong = _wrong_source(entity)
    good, faults = split_faults(pages.where(wrong.isNull()), entity, mode="reject")
    faults = faults.unionByName(pages.where(wrong.isNotNull()).select("source", "requested_start", wrong.alias("fault")))
    recs = explode_pages(good, entity, keep=["tenant_id", "branch_id", "seq"])
    rows = (normalize_party(recs, keep=["tenant_id", "branch_id", "seq", "pos"])
            .withColumn("batch_no", F.lit(batch_id).cast("int")).withColumn("type", F.lit(entity)))
    return rows, faults


# ------------------------------------------------------------------ one batch into the table

def _side(root: str, name: str, stream: str, batch_id: int) -> str:
    return f"{root}/_side/{name}/stream={C.folder_name(stream)}/batch_id={batch_id}"


def _stage(spark: SparkSession, root: str, state: C.TableState, stage: str, stream: str, batch_id: int, rows: DataFrame, types: DataFrame,
           branches: DataFrame, upsert_kw: dict) -> None:
    """The upsert's result for the touched partitions under ``stage``, and its side outputs."""
    nb = state.buckets
    parts = ["tenant_id"] + (["bucket"] if nb else [])
    data = read_data(spark, root)
    tenants = save_keys(rows, f"{stage}/tenants", ["tenant_id"])
    if nb:
        qb = F.nullif(F.col("qb_id"), F.lit(""))
        keyed = save_keys(rows.where(qb.isNotNull()).select("tenant_id", bucket_of(qb, nb).alias("bucket")), f"{stage}/keys", parts)
        target = restrict_partitions(data, keyed, parts)
        # The rest of these tenants is only read for name uniqueness.
        others = restrict_partitions(restrict_partitions(data, tenants, ["tenant_id"]), keyed, parts, negate=True).select("tenant_id", "qb_id", "name")
        upsert_kw = {**upsert_kw, "name_scope": others}
    else:
        target = restrict_partitions(data, tenants, parts)
    result = upsert_entities(target, rows, types, branches, reserve=lambda n: C.reserve_ids(spark, root, stream, batch_id, n), **upsert_kw)
    out = result.entities
    if nb:
        out = out.withColumn("bucket", entity_bucket(nb))
        # New rows without an external id land in buckets by id; keep the
        # existing rows of any such bucket the keys did not bring in.
        new_parts = result.inserted.where(F.col("qb_id").isNull()).select("tenant_id", entity_bucket(nb).alias("bucket"))
        extra = save_keys(restrict_partitions(new_parts, keyed, parts, negate=True), f"{stage}/extra", parts)
        out = out.unionByName(restrict_partitions(data, extra, parts).select(*out.columns))
    gathered(out, parts).write.mode("overwrite").partitionBy(*parts).parquet(f"{stage}/rows")
    for name, df in (("assignments", result.assignments), ("branch_links", result.branch_links), ("rejects", result.rejects), ("summary", result.stats)):
        df.write.mode("overwrite").parquet(_side(root, name, stream, batch_id))


def sync_into_table(spark: SparkSession, rows: DataFrame, batch_id: int, table_root: str, types: DataFrame,
                    branches: DataFrame, faults: DataFrame | None = None, stream: str = "batch", done: DataFrame | None = None,
                    lease: float = C.LEASE, **upsert_kw) -> bool:
    """Upsert sync rows (batch_no, tenant_id, pos, text..., qb_id, type,
    branch_id) into the partitioned table at ``table_root``, touching only the
    tenants present in ``rows`` -- and, when the table is bucketed, only the
    buckets of their external ids.  Used by the stream below and by batch jobs
    alike.  Returns False when ``batch_id`` of ``stream`` was already applied.

    ``done`` (tenant_id, type): the runs that get their marker; without it the
    tenants and types of ``rows``.  A run all of whose rows were rejected gets
    none.  ``lease``: how long another driver's declared commit is waited for."""
    root = table_root.rstrip("/")
    with C.one_at_a_time(root):
        while True:
            C.settle_pending(spark, root, stream, lease)
            state = C.load(spark, root)
            if state.last(stream) >= batch_id:
                _mark_again(spark, root, state, stream, batch_id)
                return False
            stage = C.stage_path(root, stream, batch_id, state.version)
            if not C.is_staged(spark, stage):
                # The batch feeds several jobs: written once.
                rows.write.mode("overwrite").parquet(f"{stage}/batch")
                batch = spark.read.schema(rows.schema).parquet(f"{stage}/batch")
                _stage(spark, root, state, stage, stream, batch_id, batch, types, branches, upsert_kw)
                runs = done if done is not None else batch.select("tenant_id", "type").distinct()
                runs.write.mode("overwrite").parquet(_side(root, "runs", stream, batch_id))
                if faults is not None:
                    faults.write.mode("overwrite").parquet(_side(root, "faults", stream, batch_id))
                C.mark_staged(spark, stage)
            try:
                C.commit_stage(spark, root, stream, batch_id, state.version, stage, ["tenant_id"] + (["bucket"] if state.buckets else []))
            except C.Conflict:
                C.drop_stage(spark, stage)  # another stream's rows are in the table now: compute on them
                continue
            mark_synced(spark, root, stream, batch_id)
            return True


def mark_synced(spark: SparkSession, root: str, stream: str, batch_id: int) -> None:
    """U8: the markers of the runs that this batch has applied, kept per batch and merged into the table's settings.

    It follows the commit; a replay of a batch that stopped in between makes up for it, and doing it twice changes nothing."""
    done = spark.read.schema("tenant_id int, type string").parquet(_side(root, "runs", stream, batch_id))
    told = spark.read.parquet(_side(root, "summary", stream, batch_id)).where("fetched > 0 and fetched = rejected").select("tenant_id", "type")
    good = done.select("tenant_id", "type").distinct().join(told, ["tenant_id", "type"], "left_anti").checkpoint()
    new = reduce(DataFrame.unionByName, [sync_markers(good.where(F.col("type") == t).select("tenant_id").distinct(), m, batch_id) for t, m in MARKERS.items()])
    new.write.mode("overwrite").parquet(_side(root, "markers", stream, batch_id))
    new = spark.read.schema(new.schema).parquet(_side(root, "markers", stream, batch_id))
    old = read_settings(spark, root)
    if not new.join(old, ["tenant_id", "name", "qb_id"], "left_anti").isEmpty():
        commit_table(save_defaults(old, new, ["tenant_id"]), f"{root}/_settings", partition_by=[])


def _mark_again(spark: SparkSession, root: str, state: C.TableState, stream: str, batch_id: int) -> None:
    """On a replay of the last applied batch: its markers, should it have stopped before them (not if it was quarantined)."""
    if state.last(stream) == batch_id and C.exists(spark, _side(root, "runs", stream, batch_id)) and not C.exists(spark, _side(root, "quarantine", stream, batch_id)):
        mark_synced(spark, root, stream, batch_id)


def read_settings(spark: SparkSession, root: str) -> DataFrame:
    """The settings that belong to the table: sync markers by tenant."""
    path = f"{root.rstrip('/')}/_settings"
    return read_table(spark, path) if current_pointer(spark, path) is not None else spark.createDataFrame([], SETTINGS)


def apply_landed_batch(spark: SparkSession, pages: DataFrame, batch_id: int, table_root: str, types: DataFrame,
                       branches: DataFrame, entity: str = "Customer", stream: str | None = None, page_size: int = S.PAGE_SIZE, **kw) -> bool:
    """Apply one batch of landed pages to the partitioned table at
    ``table_root``.  Returns False when the batch was already applied.

    Only whole runs are applied: pages of a run with a gap or a fault go to the
    faults (the stream below would wait for them)."""
    stream = stream or f"{entity}/batch"
    state = C.load(spark, table_root)
    if state.last(stream) >= batch_id:
        _mark_again(spark, table_root.rstrip("/"), state, stream, batch_id)
        return False
    if "fetch_seq" not in pages.columns:
        pages = pages.withColumn("fetch_seq", F.lit(None).cast("long"))
    known = source_parts(pages).where(_wrong_source(entity).isNull()).select(*pages.columns)
    whole = whole_runs(known, entity, page_size).checkpoint()
    in_run = (F.col("p.source") == F.col("w.source")) & F.col("p.fetch_seq").eqNullSafe(F.col("w.fetch_seq"))
    held = known.alias("p").join(whole.alias("w"), in_run, "left_anti")
    _, told = landed_rows(pages, batch_id, entity)
    gaps = split_faults(held, entity)[0].select("source", "requested_start", F.lit("Page of a run that is not whole").alias("fault"))
    rows, _ = landed_rows(known.alias("p").join(whole.alias("w"), in_run, "left_semi"), batch_id, entity)
    done = source_parts(whole).select("tenant_id", F.lit(entity).alias("type")).distinct()
    return sync_into_table(spark, rows, batch_id, table_root, types, branches, faults=told.unionByName(gaps), stream=stream, done=done, **kw)


# ------------------------------------------------------------------ the stream

def _apply_released(spark: SparkSession, released: DataFrame, batch_id: int, root: str, types: DataFrame, branches: DataFrame, entity: str,
                    stream: str, kw: dict) -> None:
    pages = read_released(spark, released.where("kind = 'page'"), LANDED_PAGE)
    rows, late = landed_rows(pages, batch_id, entity)
    faults = released.where("kind = 'fault'").select("source", "requested_start", "fault").unionByName(late)
    done = source_parts(released.where("kind = 'page'").select("source").distinct()).select("tenant_id", F.lit(entity).alias("type")).distinct()
    sync_into_table(spark, rows, batch_id, root, types, branches, faults=faults, stream=stream, done=done, **kw)


def _within(spark: SparkSession, seconds: float | None, work) -> None:
    """Runs ``work``; with a limit its Spark jobs are cancelled when the time is over, so it fails."""
    if seconds is None:
        return work()
    sc, tag = spark.sparkContext, f"sync-{uuid.uuid4().hex}"
    clock = threading.Timer(seconds, lambda: sc.cancelJobsWithTag(tag))
    sc.addJobTag(tag)
    clock.start()
    try:
        work()
    finally:
        clock.cancel()
        sc.removeJobTag(tag)


def quarantine(spark: SparkSession, released: DataFrame, root: str, stream: str, batch_id: int, error: str) -> None:
    """The pages of a batch that failed for good, with the error; the batch then counts as applied."""
    released.withColumn("error", F.lit(error[:2000])).write.mode("overwrite").parquet(_side(root.rstrip("/"), "quarantine", stream, batch_id))
    C.skip_batch(spark, root, stream, batch_id)


def start_sync(spark: SparkSession, landing_dir: str, table_root: str, checkpoint: str, types: DataFrame,
               branches: DataFrame, entity: str = "Customer", files_per_batch: int | None = None,
               available_now: bool = True, page_size: int = S.PAGE_SIZE, max_attempts: int = MAX_ATTEMPTS, time_limit: float | None = None,
               lease: float = C.LEASE, gate_partitions: int = GATE_PARTITIONS, **upsert_kw):
    """Start the streaming sync of one entity; returns the StreamingQuery.

    Several such streams may write one table.  A batch that fails is tried ``max_attempts`` times in all (a driver
    that stops within an attempt has used it up), each within ``time_limit`` seconds; then its pages are quarantined.
    ``gate_partitions``: over how many state stores the gate's descriptors are dealt (fixed at a checkpoint's first start);
    all other work follows the session's settings."""
    reader = spark.readStream.schema(LANDED_PAGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    pages = source_parts(reader.json(landing_dir).select("*", F.col("_metadata.file_path").alias("path")))
    wrong = _wrong_source(entity)
    foreign = pages.where(wrong.isNotNull()).select("source", F.lit("fault").alias("kind"), "fetch_seq", "requested_start", F.lit(0).cast("long").alias("n"), "path",
                                                    F.lit(1).cast("long").alias("landings"), wrong.alias("fault"))
    let_out = gate(pages.where(wrong.isNull()), entity, page_size).unionByName(foreign)
    root = table_root.rstrip("/")

    def each(batch_df: DataFrame, batch_id: int) -> None:
        stream = f"{entity}/{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or checkpoint}"
        state = C.load(spark, root)
        if state.last(stream) >= batch_id:
            return _mark_again(spark, root, state, stream, batch_id)
        # The gate's output is read by several jobs: written once, under the name of its batch.
        path = _side(root, "released", stream, batch_id)
        batch_df.write.mode("overwrite").parquet(path)
        released = spark.read.schema(RELEASED).parquet(path)  # from here on with the caller's settings, not the gate's
        if released.isEmpty():
            return
        while True:
            attempt = C.begin_attempt(spark, root, stream, batch_id)
            if attempt > max_attempts:
                return quarantine(spark, released, root, stream, batch_id, "stopped in its last attempt")
            try:
                return _within(spark, time_limit, lambda: _apply_released(spark, released, batch_id, root, types, branches, entity, stream,
                                                                            {"lease": lease, **upsert_kw}))
            except Exception as e:  # noqa: BLE001 - whatever the batch does, the stream must go on
                if attempt == max_attempts:
                    return quarantine(spark, released, root, stream, batch_id, f"{type(e).__name__}: {e}")
                time.sleep(PAUSE)

    w = let_out.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    # A query keeps the settings that it was started with.
    own = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.shuffle.partitions": str(gate_partitions)}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        return w.start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
