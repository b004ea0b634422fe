"""Incremental sync (T1): micro-batches upsert landed pages; a replayed batch
is skipped; split files give the same table as one batch when ids do not
repeat across files."""

import json

from pyspark.sql.types import StructType

from tallyspark import schemas as S
from tallyspark.sources.pages import LANDED_PAGE
from tallyspark.sources.tables import init_partitioned, read_partitions, read_state
from tallyspark.streaming.incremental import apply_landed_batch, start_sync


def _setup(spark, tmp_path):
    root = str(tmp_path / "ent")
    target = spark.createDataFrame([(1, "A", "", "", "keep", None, "7", 0, False, None, "")], S.ENTITIES)
    init_partitioned(target, root)
    types = spark.createDataFrame([(i + 1, n) for i, n in enumerate(S.ENTITY_TYPE_NAMES)], S.ENTITY_TYPES)
    branches = spark.createDataFrame([(1, 0, "Main")], S.BRANCHES)
    return root, types, branches


def _page(records, start=1, tenant=0, branch=1):
    body = json.dumps({"QueryResponse": {"Customer": records, "startPosition": start}})
    return (f"Customer/{tenant}/{branch}", start, body)


def test_replayed_batch_is_skipped(spark, tmp_path):
    root, types, branches = _setup(spark, tmp_path)
    pages = spark.createDataFrame([_page([{"Id": "7", "DisplayName": "A2"}, {"Id": "8", "DisplayName": "B"}])],
                                  StructType(LANDED_PAGE.fields[:3]))
    assert apply_landed_batch(spark, pages, 0, root, types, branches) is True
    assert apply_landed_batch(spark, pages, 0, root, types, branches) is False
    assert read_state(spark, root) == (0, 2)
    assert sorted((r["id"], r["name"]) for r in read_partitions(spark, root).collect()) == [(1, "A2"), (2, "B")]


def test_only_touched_tenants_rewritten(spark, tmp_path):
    root, types, branches = _setup(spark, tmp_path)
    other = spark.createDataFrame([(5, "Z", "", "", "keep", None, "z", 3, False, None, "")], S.ENTITIES)
    other.write.mode("append").partitionBy("tenant_id").parquet(root + "/data")
    import glob
    before = sorted(glob.glob(root + "/data/tenant_id=3/*.parquet"))
    pages = spark.createDataFrame([_page([{"Id": "7", "DisplayName": "A9"}])], StructType(LANDED_PAGE.fields[:3]))
    assert apply_landed_batch(spark, pages, 0, root, types, branches)
    assert sorted(glob.glob(root + "/data/tenant_id=3/*.parquet")) == before
    got = sorted((r["tenant_id"], r["name"]) for r in read_partitions(spark, root).collect())
    assert got == [(0, "A9"), (3, "Z")]


def test_stream_available_now(spark, tmp_path):
    root, types, branches = _setup(spark, tmp_path)
    landing = str(tmp_path / "landing")
    for i, recs in enumerate([[{"Id": "7", "DisplayName": "A3"}], [{"Id": "9", "DisplayName": "C"}]]):
        spark.createDataFrame([_page(recs)], StructType(LANDED_PAGE.fields[:3])).coalesce(1).write.mode("append").json(landing)
    ckpt = str(tmp_path / "ckpt")
    start_sync(spark, landing, root, ckpt, types, branches, files_per_batch=1).awaitTermination()
    got = sorted((r["id"], r["name"]) for r in read_partitions(spark, root).collect())
    assert got == [(1, "A3"), (2, "C")]
    # Restart on the same checkpoint: nothing new, nothing changes.
    start_sync(spark, landing, root, ckpt, types, branches, files_per_batch=1).awaitTermination()
    assert sorted((r["id"], r["name"]) for r in read_partitions(spark, root).collect()) == got


def _bucketed(spark, tmp_path, rows, buckets=8):
    root = str(tmp_path / "bent")
    target = spark.createDataFrame(rows, S.ENTITIES)
    init_partitioned(target, root, buckets=buckets)
    types = spark.createDataFrame([(i + 1, n) for i, n in enumerate(S.ENTITY_TYPE_NAMES)], S.ENTITY_TYPES)
    branches = spark.createDataFrame([(1, 0, "Main")], S.BRANCHES)
    return root, types, branches


def _files(root):
    import glob
    return {p: __import__("os").path.getmtime(p) for p in glob.glob(root + "/data/*/*/*.parquet")}


def test_bucketed_rewrites_only_touched_buckets(spark, tmp_path):
    rows = [(i, f"E{i}", "", "", "keep", None, str(i), 0, False, None, "") for i in range(1, 41)]
    root, types, branches = _bucketed(spark, tmp_path, rows)
    before = _files(root)
    pages = spark.createDataFrame([_page([{"Id": "7", "DisplayName": "Seven"}])], StructType(LANDED_PAGE.fields[:3]))
    assert apply_landed_batch(spark, pages, 0, root, types, branches)
    after = _files(root)
    changed_dirs = {p.rsplit("/", 1)[0] for p in set(before) ^ set(after)}
    assert len(changed_dirs) == 1  # one bucket of one tenant
    got = {r["id"]: r["name"] for r in read_partitions(spark, root).collect()}
    assert len(got) == 40 and got[7] == "Seven" and got[8] == "E8"


def test_bucketed_name_check_sees_other_buckets(spark, tmp_path):
    rows = [(i, f"E{i}", "", "", "keep", None, str(i), 0, False, None, "") for i in range(1, 41)]
    root, types, branches = _bucketed(spark, tmp_path, rows)
    # Rename 7 to the name held by 8 (almost surely another bucket): rejected.
    pages = spark.createDataFrame([_page([{"Id": "7", "DisplayName": "e8"}])], StructType(LANDED_PAGE.fields[:3]))
    assert apply_landed_batch(spark, pages, 0, root, types, branches)
    got = {r["id"]: r["name"] for r in read_partitions(spark, root).collect()}
    assert got[7] == "E7"


def test_bucketed_null_id_insert_keeps_its_bucket(spark, tmp_path):
    rows = [(i, f"E{i}", "", "", "keep", None, None if i % 2 else str(i), 0, False, None, "") for i in range(1, 41)]
    root, types, branches = _bucketed(spark, tmp_path, rows, buckets=4)
    pages = spark.createDataFrame([_page([{"DisplayName": "NoId"}])], StructType(LANDED_PAGE.fields[:3]))
    assert apply_landed_batch(spark, pages, 0, root, types, branches)
    got = {r["id"]: r["name"] for r in read_partitions(spark, root).collect()}
    assert len(got) == 41 and got[41] == "NoId"
    assert read_state(spark, root) == (0, 41)


def test_mapping_moves_rows_between_buckets(spark, tmp_path):
    from tallyspark.operators.mapping import apply_mappings_into_table
    rows = [(i, f"E{i}", "", "", "keep", "Customer", None if i % 2 else str(i), 0, False, None, "")
            for i in range(1, 41)]
    root, _, _ = _bucketed(spark, tmp_path, rows, buckets=4)
    skus = spark.createDataFrame([], S.SKUS)
    m = spark.createDataFrame([(3, "Q3", "Customer", 0, 1), (4, "Q4", "Customer", 0, 1)],
                              "internal_id long, external_id string, type string, tenant_id int, seq long")
    r = apply_mappings_into_table(spark, m, root, skus, type_source="column")
    assert r.applied.count() == 2
    got = {x["id"]: x["qb_id"] for x in read_partitions(spark, root).collect()}
    assert len(got) == 40 and got[3] == "Q3" and got[4] == "Q4" and got[5] is None and got[6] == "6"
    import glob
    for d in glob.glob(root + "/data/tenant_id=0/bucket=*"):
        b = int(d.rsplit("=", 1)[1])
        ids = [x["id"] for x in spark.read.parquet(d).collect()]
        # every row sits in the bucket of its (new) external id
        exp = spark.createDataFrame([(i, got[i]) for i in ids], "id long, qb_id string").select(
            __import__("tallyspark.sources.tables", fromlist=["x"]).entity_bucket(4).alias("b")).collect()
        assert all(e["b"] == b for e in exp)


def test_mapping_empties_a_bucket(spark, tmp_path):
    """The only row of a bucket moves away: it must not stay behind in the old file."""
    from tallyspark.operators.mapping import apply_mappings_into_table
    rows = [(i, f"E{i}", "", "", "keep", "Customer", str(i), 0, False, None, "") for i in range(1, 5)]
    root, _, _ = _bucketed(spark, tmp_path, rows, buckets=64)
    m = spark.createDataFrame([(2, "Q2", "Customer", 0, 1)], "internal_id long, external_id string, type string, tenant_id int, seq long")
    apply_mappings_into_table(spark, m, root, spark.createDataFrame([], S.SKUS), type_source="column")
    assert sorted((x["id"], x["qb_id"]) for x in read_partitions(spark, root).collect()) == [(1, "1"), (2, "Q2"), (3, "3"), (4, "4")]


def test_a_run_leaves_its_summary_links_and_marker(spark, tmp_path):
    root, types, branches = _setup(spark, tmp_path)
    for n, recs in enumerate([[{"Id": "7", "DisplayName": "A2"}, {"Id": "8", "DisplayName": "B"}], [{"Id": "9", "DisplayName": "C"}]]):
        pages = spark.createDataFrame([_page(recs)], StructType(LANDED_PAGE.fields[:3]))
        assert apply_landed_batch(spark, pages, n, root, types, branches)
    side = lambda name: spark.read.parquet(f"{root}/_side/{name}")
    # Entity ids go on from the table's largest, assignment ids from their own.
    assert sorted((r["id"], r["entity"]) for r in side("assignments").collect()) == [(1, 2), (2, 3)]
    assert sorted((r["batch_id"], r["fetched"], r["inserted"], r["updated"], r["rejected"]) for r in side("summary").collect()) == [(0, 2, 1, 1, 0), (1, 1, 1, 0, 0)]
    assert [(r["tenant_id"], r["name"], r["qb_id"]) for r in side("markers").where("batch_id = 1").collect()] == [(0, "customers_synced", "1")]


def test_few_files_per_partition(spark, tmp_path):
    import glob
    df = spark.range(20000).selectExpr("id", "cast(id % 5 as int) tenant_id", "cast(id as string) qb_id").repartition(8)
    init_partitioned(df, str(tmp_path / "t"), buckets=8)
    assert len(glob.glob(str(tmp_path / "t/data/*/*/*.parquet"))) <= 2 * 5 * 8


def test_sync_into_table_as_batch_job(spark, tmp_path):
    """The tenant-scoped commit used directly by a batch job: only tenant 0's
    partition changes; tenant 1 keeps its files."""
    from tallyspark.streaming.incremental import sync_into_table
    root, types, branches = _setup(spark, tmp_path)
    other = spark.createDataFrame([(5, "Z", "", "", "keep", None, "z", 1, False, None, "")], S.ENTITIES)
    other.write.mode("append").partitionBy("tenant_id").parquet(root + "/data")
    import glob
    before = sorted(glob.glob(root + "/data/tenant_id=1/*.parquet"))
    rows = spark.createDataFrame([(3, 0, 0, "A5", None, None, None, None, "7", "Customer", 1),
                                  (3, 0, 1, "New", None, None, None, None, "9", "Vendor", 1)],
                                 "batch_no int, tenant_id int, pos long, name string, email string, phone string, "
                                 "address string, note string, qb_id string, type string, branch_id int")
    assert sync_into_table(spark, rows, 3, root, types, branches)
    assert not sync_into_table(spark, rows, 3, root, types, branches)  # replay: skipped
    assert sorted(glob.glob(root + "/data/tenant_id=1/*.parquet")) == before
    got = sorted((r["tenant_id"], r["id"], r["name"]) for r in read_partitions(spark, root).collect())
    assert got == [(0, 1, "A5"), (0, 2, "New"), (1, 5, "Z")]
