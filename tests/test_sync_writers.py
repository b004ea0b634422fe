"""Several writers on one table, the completeness gate, attempts and quarantine, stops in a commit, clash chains."""

import importlib
import json
import re
import threading

import pytest
from pyspark.sql import functions as F

from core_helpers import rows
from tallyspark import schemas as S
from tallyspark.operators.mapping import apply_mappings_into_table
from tallyspark.operators.settings import save_defaults
from tallyspark.sources import commits as C
from tallyspark.sources import tables as T
from tallyspark.sources.pages import LANDED_PAGE
from tallyspark.sources.tables import init_partitioned, read_data, read_partitions, read_state, restrict_partitions, save_keys
from tallyspark.streaming import incremental as I
from tallyspark.streaming.gate import whole_runs

U = importlib.import_module("tallyspark.operators.upsert")
ENTITY = "id long, name string, email string, phone string, note string, type string, qb_id string, tenant_id int, is_intrinsic boolean, ntn int, address string"


def lookups(spark):
    return (spark.createDataFrame([(i + 1, n) for i, n in enumerate(S.ENTITY_TYPE_NAMES)], S.ENTITY_TYPES),
            spark.createDataFrame([(1, t, "Main") for t in range(5)], S.BRANCHES))


def page(entity, tenant, recs, start=1, seq=None, fault=False):
    body = {"Fault": {"Error": [{"Message": "busy"}]}} if fault else {"QueryResponse": {entity: [{"Id": i, "DisplayName": n} for i, n in recs]}}
    return (f"{entity}/{tenant}/1", start, json.dumps(body), seq)


def land(spark, folder, *pages):
    spark.createDataFrame(list(pages), LANDED_PAGE).coalesce(1).write.mode("append").json(folder)


def table(spark, root, buckets=4, held=()):
    init_partitioned(spark.createDataFrame(list(held), ENTITY), root, buckets=buckets)


def names(spark, root):
    return sorted(((r.tenant_id, r.qb_id, r.name) for r in read_partitions(spark, root).collect()), key=repr)


def markers(spark, root):
    return sorted((r.tenant_id, r.name) for r in I.read_settings(spark, root).collect())


def run(spark, tmp_path, root, entity="Customer", **kw):
    q = I.start_sync(spark, str(tmp_path / entity), root, str(tmp_path / f"ckpt-{entity}"), *lookups(spark), entity, page_size=2, files_per_batch=1, **kw)
    q.awaitTermination()


@pytest.mark.parametrize("buckets", [None, 4])
def test_two_streams_fill_an_empty_table(spark, tmp_path, buckets):
    """Customers and vendors in turn, from nothing, with replays: no row is lost, ids never clash."""
    root = str(tmp_path / "t")
    table(spark, root, buckets)
    assert read_data(spark, root).count() == 0
    want = []
    for n in range(2):
        for entity in ("Customer", "Vendor"):
            recs = [(f"{entity[0]}{n}", f"{entity} {n}")]
            want += [(1, *r) for r in recs]
            land(spark, str(tmp_path / entity), page(entity, 1, recs, seq=n))
            run(spark, tmp_path, root, entity)
            run(spark, tmp_path, root, entity)  # nothing new
    assert names(spark, root) == sorted(want)
    ids = [r.id for r in read_partitions(spark, root).collect()]
    assert sorted(ids) == [1, 2, 3, 4] and read_state(spark, root) == (1, 4)
    assert markers(spark, root) == [(1, "customers_synced"), (1, "vendors_synced")]
    links = spark.read.parquet(f"{root}/_side/assignments")
    assert sorted((r.id, r.entity, r.type) for r in links.collect()) == [(1, 1, 1), (2, 2, 2), (3, 3, 1), (4, 4, 2)]


def test_the_gate_waits_for_a_whole_run(spark, tmp_path):
    root, folder = str(tmp_path / "t"), str(tmp_path / "Customer")
    table(spark, root)
    two = lambda a: [(f"{a}{i}", f"n{a}{i}") for i in range(2)]
    # Tenant 1: a gap.  Tenant 2: a fault.  Tenant 3: whole, with an empty last page.  Tenant 4: whole and without rows.
    land(spark, folder, page("Customer", 1, two("a")), page("Customer", 1, [("c0", "nc0")], start=5), page("Customer", 2, two("d")), page("Customer", 2, [], start=3, fault=True),
         page("Customer", 3, two("e")), page("Customer", 3, [], start=3), page("Customer", 4, []), page("Vendor", 0, two("v")), page("Customer", "x", two("w")))
    run(spark, tmp_path, root)
    assert names(spark, root) == [(3, "e0", "ne0"), (3, "e1", "ne1")]
    assert markers(spark, root) == [(3, "customers_synced"), (4, "customers_synced")]
    faults = spark.read.parquet(f"{root}/_side/faults")
    assert faults.count() == 3 and faults.where("fault like '%busy%'").count() == 1
    # The missing page, and the good form of the faulted one, come later: both runs are released.
    land(spark, folder, page("Customer", 1, two("b"), start=3))
    land(spark, folder, page("Customer", 2, [("d2", "nd2")], start=3))
    run(spark, tmp_path, root)
    assert names(spark, root) == sorted([(1, x, f"n{x}") for x in ("a0", "a1", "b0", "b1", "c0")] + [(2, f"d{i}", f"nd{i}") for i in range(3)] + [(3, "e0", "ne0"), (3, "e1", "ne1")])
    assert [t for t, _ in markers(spark, root)] == [1, 2, 3, 4]


def test_an_older_run_is_superseded(spark, tmp_path):
    root, folder = str(tmp_path / "t"), str(tmp_path / "Customer")
    table(spark, root)
    land(spark, folder, page("Customer", 1, [("a", "old"), ("b", "old b")], seq=1))
    land(spark, folder, page("Customer", 1, [("a", "new")], seq=2))
    land(spark, folder, page("Customer", 1, [("c", "late")], start=3, seq=1))
    run(spark, tmp_path, root)
    assert names(spark, root) == [(1, "a", "new")]
    assert [r.fault for r in spark.read.parquet(f"{root}/_side/faults").collect()] == ["Page of a superseded run"]


def test_whole_runs_of_a_frame(spark):
    two = [("a", "a"), ("b", "b")]
    pages = [page("Customer", 1, two), page("Customer", 1, [], start=3), page("Customer", 2, two), page("Customer", 3, two, start=3), page("Customer", 3, [], start=5), page("Customer", 4, [("x", "x")], seq=7),
             page("Customer", 4, two, seq=8), page("Customer", 4, [], start=3, seq=8, fault=True), page("Customer", 0, two), page("Customer", 0, two), page("Customer", 0, [("z", "z")], start=3), page("Customer", 0, two, start=5)]
    got = whole_runs(spark.createDataFrame(pages, LANDED_PAGE), "Customer", 2)
    assert sorted((r.source, r.fetch_seq or 0) for r in got.collect()) == [("Customer/0/1", 0), ("Customer/1/1", 0), ("Customer/4/1", 7)]


def test_a_poisoned_batch_goes_to_quarantine(spark, tmp_path, monkeypatch):
    """A run that fails each time is tried three times; the next one is applied."""
    monkeypatch.setattr(I, "PAUSE", 0.0)
    root, folder = str(tmp_path / "t"), str(tmp_path / "Customer")
    table(spark, root)
    land(spark, folder, page("Customer", 9, [("p", "no branch for this tenant")]))
    land(spark, folder, page("Customer", 1, [("q", "good")]))
    tries = []
    first = I._apply_released
    monkeypatch.setattr(I, "_apply_released", lambda *a: (tries.append(a[2]), first(*a)))
    run(spark, tmp_path, root, on_error="fail")
    assert names(spark, root) == [(1, "q", "good")] and tries == [0, 0, 0, 1]
    held = spark.read.parquet(f"{root}/_side/quarantine").collect()
    assert [(r.source, r.batch_id) for r in held] == [("Customer/9/1", 0)] and "Branch ID 1 does not exist" in held[0].error
    assert markers(spark, root) == [(1, "customers_synced")]


def test_attempts_outlive_the_driver(spark, tmp_path, monkeypatch):
    """Attempts are counted before they are made, so a driver that stopped within its last one has used it up."""
    root, folder = str(tmp_path / "t"), str(tmp_path / "Customer")
    table(spark, root)
    assert [C.begin_attempt(spark, root, "s", b) for b in (0, 0, 0, 1)] == [1, 2, 3, 1]
    land(spark, folder, page("Customer", 1, [("q", "deadly")]))
    real = C.begin_attempt
    monkeypatch.setattr(C, "begin_attempt", lambda *a: real(*a) + 3)
    run(spark, tmp_path, root)
    assert names(spark, root) == [] and spark.read.parquet(f"{root}/_side/quarantine").count() == 1


def test_a_run_that_takes_too_long(spark):
    slow = F.expr("java_method('java.lang.Thread', 'sleep', cast(20000 as bigint))")
    with pytest.raises(Exception, match="(?i)cancel"):
        I._within(spark, 1.0, lambda: spark.range(2).select(slow).collect())
    I._within(spark, 30.0, lambda: spark.range(2).collect())


def sync(spark, root, batch, recs, stream="batch", tenant=1):
    cols = "batch_no int, tenant_id int, pos long, name string, email string, phone string, address string, note string, qb_id string, type string, branch_id int"
    df = spark.createDataFrame([(batch, tenant, i, n, None, None, None, None, q, "Customer", 1) for i, (q, n) in enumerate(recs)], cols)
    return I.sync_into_table(spark, df, batch, root, *lookups(spark), stream=stream, lease=0)


@pytest.mark.parametrize("stop_at", ["after_replace", "close"])
def test_a_stop_in_a_commit(spark, tmp_path, monkeypatch, stop_at):
    """Whatever step a commit stops at, the next writer closes it: NULL ids are inserted once, other streams see it."""
    root = str(tmp_path / "t")
    table(spark, root)
    assert sync(spark, root, 0, [("a", "A"), (None, "B")])
    with monkeypatch.context() as m:
        if stop_at == "close":
            real, seen = C.change, []

            def change(s, r, edit):
                if edit.__name__ == "close":
                    raise RuntimeError("stop")
                return real(s, r, edit)

            m.setattr(C, "change", change)
        else:
            real = T.replace_partitions

            def replace(*a):
                if stop_at == "after_replace":
                    real(*a)
                raise RuntimeError("stop")

            m.setattr(T, "replace_partitions", replace)
        with pytest.raises(RuntimeError):
            sync(spark, root, 1, [("a", "A2"), (None, "C")])
    assert sync(spark, root, 0, [("z", "Z")], stream="other")
    assert not sync(spark, root, 1, [("a", "A2"), (None, "C")])  # it was closed by the other writer
    assert sorted(n for _, _, n in names(spark, root)) == ["A2", "B", "C", "Z"]
    assert sorted(r.id for r in read_partitions(spark, root).collect()) == [1, 2, 3, 4]


def test_a_stage_from_an_older_version_is_made_anew(spark, tmp_path, monkeypatch):
    """Another driver commits between stage and commit: the name it took is seen."""
    root = str(tmp_path / "t")
    table(spark, root)
    real, other = C.mark_staged, []

    def staged(s, stage):
        real(s, stage)
        if not other:
            other.append(1)
            sync(s, root, 0, [("o", "Same")], stream="other")

    monkeypatch.setattr(C, "mark_staged", staged)
    assert sync(spark, root, 0, [("a", "same"), ("b", "Free")])
    assert names(spark, root) == [(1, "b", "Free"), (1, "o", "Same")]


def test_id_blocks_never_clash(spark, tmp_path):
    root, got = str(tmp_path / "t"), []
    table(spark, root)
    work = [threading.Thread(target=lambda s=s: got.append((s, C.reserve_ids(spark, root, s, 0, 5)))) for s in "abcdefgh"]
    for w in work:
        w.start()
    for w in work:
        w.join()
    assert sorted(b for _, (b, _) in got) == [1 + 5 * i for i in range(8)] and C.load(spark, root).max_id == 40
    again = dict(got)["c"]
    assert C.reserve_ids(spark, root, "c", 0, 5) == again and C.reserve_ids(spark, root, "c", 1, 2) == (41, 41)
    state = C.load(spark, root)
    assert C.write_next(spark, root, state.seq, state) and not C.write_next(spark, root, state.seq - 1, state)


def test_another_drivers_commit_is_waited_for(spark, tmp_path):
    root = str(tmp_path / "t")
    table(spark, root)
    C.change(spark, root, lambda s: setattr(s, "pending", {"stream": "x", "batch_id": 0, "stage": root + "/none", "parts": [], "owner": "else", "at": 4e9}))
    with pytest.raises(C.Busy):
        C.settle_pending(spark, root, "batch")


def test_keys_prune_partitions(spark, tmp_path):
    """The same plan for a few and for very many keys: a join that prunes the scan, no values in the plan."""
    root = str(tmp_path / "t")
    df = spark.range(5000).selectExpr("id", "cast(id % 50 as int) tenant_id", "cast(id as string) qb_id")
    init_partitioned(df, root, buckets=4)
    plans = []
    for n in (3, 100_000):
        keys = save_keys(spark.range(n).selectExpr("cast(id as int) tenant_id", "cast(id % 4 as int) bucket"), str(tmp_path / f"k{n}"), ["tenant_id", "bucket"])
        got = restrict_partitions(read_data(spark, root), keys, ["tenant_id", "bucket"])
        assert got.count() == read_data(spark, root).where(f"tenant_id < {n} and bucket = tenant_id % 4").count()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "dynamicpruning" in plan.lower()
        plans.append([re.sub(r"#\d+", "", line) for line in plan.splitlines() if "Join" in line])
    assert plans[0] == plans[1]


def test_mapping_survives_a_stop(spark, tmp_path, monkeypatch):
    """A stop between the overwrite and the deletes: no entity stands in two buckets, a new run changes nothing."""
    root, skus_root = str(tmp_path / "t"), str(tmp_path / "s")
    table(spark, root, 64, [(i, f"E{i}", "", "", "", "Customer", str(i), 0, False, None, "") for i in range(1, 5)])
    skus = spark.createDataFrame([(i, 1, f"q{i}", 0, f"k{i}", 1.0, 5.0) for i in range(1, 4)], S.SKUS)
    init_partitioned(skus, skus_root, buckets=8)
    m = spark.createDataFrame([(2, "Q2", "Customer", 0, 1), (3, "K3", "Item", 0, 2)], "internal_id long, external_id string, type string, tenant_id int, seq long")
    kw = {"skus_root": skus_root, "type_source": "column", "batch_id": 0, "lease": 0}
    for step in ("delete_partitions", "replace_partitions"):
        with monkeypatch.context() as mp:
            mp.setattr(T, step, lambda *a: (_ for _ in ()).throw(RuntimeError("stop")))
            with pytest.raises(RuntimeError):
                apply_mappings_into_table(spark, m, root, **kw)
    r = apply_mappings_into_table(spark, m, root, **kw)
    r = apply_mappings_into_table(spark, m, root, **kw)
    assert sorted((x.id, x.qb_id) for x in read_partitions(spark, root).collect()) == [(1, "1"), (2, "Q2"), (3, "3"), (4, "4")]
    assert sorted((x.id, x.qb_id) for x in read_partitions(spark, skus_root).collect()) == [(1, "q1"), (2, "q2"), (3, "K3")]
    assert rows(r.applied, "target_table", "id", "old_qb_id", "new_qb_id") == [("entities", 2, "2", "Q2"), ("skus", 3, "q3", "K3")]


def chain(spark, n, end_held):
    held = [(i, f"n{i}", "", "", "", None, f"q{i}", 1, False, None, "") for i in range(n + end_held)]
    moves = [(0, 1, i, f"n{i + 1}", None, None, None, None, f"q{i}", "Customer", 1) for i in range(n)]
    batch = spark.createDataFrame(moves, "batch_no int, tenant_id int, pos long, name string, email string, phone string, address string, note string, qb_id string, type string, branch_id int")
    types, branches = lookups(spark)
    return U.upsert_entities(spark.createDataFrame(held, ENTITY), batch, types, branches)


def test_a_chain_of_renames_is_resolved_once(spark, monkeypatch):
    """50 links, each rejected because the next one is: the table is resolved once, chains by doubling."""
    resolved, joins = [], []
    real, reach = U._resolve, U._reaching

    def counted(edges, goal):
        kind = type(edges)
        plain = kind.checkpoint
        with monkeypatch.context() as m:
            m.setattr(kind, "checkpoint", lambda self, *a, **k: (joins.append(1), plain(self, *a, **k))[1])
            return reach(edges, goal)

    monkeypatch.setattr(U, "_resolve", lambda *a: (resolved.append(1), real(*a))[1])
    monkeypatch.setattr(U, "_reaching", counted)
    r = chain(spark, 50, 1)
    assert sorted(x.name for x in r.entities.select("name").collect()) == sorted(f"n{i}" for i in range(51)) and r.rejects.count() == 50
    assert len(resolved) == 1 and len(joins) <= 12
    free = chain(spark, 20, 0)  # the last name is free: all move
    assert free.rejects.count() == 0 and sorted(x.name for x in free.entities.select("name").collect()) == sorted(f"n{i}" for i in range(1, 21))


def test_reaching(spark):
    """Chains, cycles, and nodes with several edges, against a plain search."""
    import random
    rng = random.Random(2)
    for _ in range(6):
        n = 30
        edges = [(i, rng.randrange(n)) for i in range(n) if rng.random() < 0.8] + [(rng.randrange(n), rng.randrange(n)) for _ in range(5)]
        goal = {rng.randrange(n) for _ in range(2)}
        want = set(goal)
        while more := {a for a, b in edges if b in want} - want:
            want |= more
        got = U._reaching(spark.createDataFrame(edges, "node long, to long"), spark.createDataFrame([(g,) for g in goal], "node long"))
        assert {r.node for r in got.collect()} == want


def test_saved_defaults_get_ids(spark):
    target = spark.createDataFrame([(4, "tax_code", "1", "a"), (7, "cash_account", "2", "b")], S.QB_DEFAULTS)
    saves = spark.createDataFrame([("x", "9", "c", 1), ("tax_code", "8", "d", 2), ("a", "7", "e", 3)], "name string, qb_id string, qb_name string, seq long").withColumn("sub", F.lit(0))
    got = save_defaults(target, saves)
    assert rows(got, "id", "name", "qb_id") == [(4, "tax_code", "8"), (7, "cash_account", "2"), (8, "a", "7"), (9, "x", "9")]
    assert got.schema["id"].dataType == target.schema["id"].dataType
    assert [r[0] for r in rows(save_defaults(target.limit(0), saves), "id")] == [1, 2, 3]
