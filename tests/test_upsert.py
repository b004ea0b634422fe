"""Entity upsert (U1/U2/U3/U10/U11) against a row-by-row replay of the two
stored procedures, plus the pinned rules of the survey."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.operators.upsert import (UpsertError, collapse_batch, insert_ignore, upsert, upsert_entities)

TYPES = S.ENTITY_TYPE_NAMES
BATCH_SCHEMA = ("batch_no int, tenant_id int, pos long, name string, email string, phone string, address string, "
                "note string, qb_id string, type string, branch_id int")


def sequential_model(target, batch, branches, types):
    """Plain-Python replay: rows in (batch_no, tenant_id, pos) order; a match
    on (qb_id, tenant) updates every matching row; otherwise branch then type
    are checked (a failure rejects the row -- the chosen divergence from
    aborting) and the row inserts with the next id."""
    ents = [dict(e) for e in target]
    next_id = max(e["id"] for e in ents) + 1
    type_ids = {n: i + 1 for i, n in enumerate(types)}
    rejects, assigns, links = [], [], []
    for r in sorted(batch, key=lambda r: (r["batch_no"], r["tenant_id"], r["pos"])):
        qb = r["qb_id"] if r["qb_id"] not in ("",) else None
        text = {c: (r[c] if r[c] is not None else "") for c in ("name", "email", "phone", "address", "note")}
        hits = [e for e in ents if qb is not None and e["qb_id"] == qb and e["tenant_id"] == r["tenant_id"]]
        if hits:
            for e in hits:
                e.update(text)
            continue
        if (r["branch_id"], r["tenant_id"]) not in branches:
            rejects.append((r["batch_no"], r["tenant_id"], r["pos"],
                            f"Branch ID {r['branch_id']} does not exist for tenant {r['tenant_id']}"))
            continue
        if r["type"] not in type_ids:
            rejects.append((r["batch_no"], r["tenant_id"], r["pos"], f'Entity type "{r["type"]}" not found in entity_types'))
            continue
        ents.append(dict(id=next_id, type=None, qb_id=qb, tenant_id=r["tenant_id"], is_intrinsic=False, ntn=None,
                         **text))
        assigns.append((next_id, type_ids[r["type"]], r["tenant_id"]))
        links.append((next_id, r["branch_id"]))
        next_id += 1
    return ents, rejects, assigns, links


def _target_rows(rng, n_tenants):
    rows, i = [], 1
    for t in range(n_tenants):
        for q in ["a", "b", "c", None, None]:
            if rng.random() < 0.6:
                rows.append(dict(id=i, name=f"old{i}", email="", phone="", note="keep", type="Customer",
                                 qb_id=q, tenant_id=t, is_intrinsic=False, ntn=None, address=""))
                i += 1
    return rows


def _batch_rows(rng, n_tenants, n_rows):
    rows = []
    for pos in range(n_rows):
        t = rng.randrange(n_tenants)
        rows.append(dict(batch_no=rng.choice([0, 0, 1]), tenant_id=t, pos=pos, name=f"n{pos}",
                         email=rng.choice([None, "", f"e{pos}"]), phone=rng.choice([None, f"p{pos}"]),
                         address=rng.choice(["", f"addr{pos}"]), note=rng.choice([None, ""]),
                         qb_id=rng.choice([None, "", "a", "b", "c", "d", "e", "e"]),
                         type=rng.choice(["Customer", "Customer", "Vendor", "Client"]),
                         branch_id=rng.choice([1, 1, 2, 9])))
    return rows


def _frames(spark, target, batch, branches):
    t = spark.createDataFrame([tuple(r[c] for c in S.ENTITY_COLUMNS) for r in target], S.ENTITIES)
    b = spark.createDataFrame([tuple(r[c] for c in BATCH_SCHEMA_COLS) for r in batch], BATCH_SCHEMA)
    br = spark.createDataFrame([(bid, t_, "b") for bid, t_ in branches], S.BRANCHES)
    ty = spark.createDataFrame([(i + 1, n) for i, n in enumerate(TYPES)], S.ENTITY_TYPES)
    return t, b, br, ty


BATCH_SCHEMA_COLS = [c.split()[0] for c in BATCH_SCHEMA.split(", ")]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sequential_model(spark, seed):
    rng = random.Random(seed)
    n_tenants = 12
    target = _target_rows(rng, n_tenants)
    batch = _batch_rows(rng, n_tenants, 240)
    branches = {(1, t) for t in range(n_tenants)} | {(2, t) for t in range(0, n_tenants, 2)}
    t, b, br, ty = _frames(spark, target, batch, branches)
    res = upsert_entities(t, b, ty, br, collation=None)

    ents, rejects, assigns, links = sequential_model(target, batch, branches, TYPES)
    got = sorted(tuple(r) for r in res.entities.select(*S.ENTITY_COLUMNS).collect())
    exp = sorted(tuple(e[c] for c in S.ENTITY_COLUMNS) for e in ents)
    assert got == exp
    got_rej = sorted(tuple(r) for r in res.rejects.select("batch_no", "tenant_id", "pos", "reason").collect())
    assert got_rej == sorted(rejects)
    got_as = sorted(tuple(r) for r in res.assignments.select("entity", "type", "tenant_id").collect())
    assert got_as == sorted(assigns)
    assert sorted(tuple(r) for r in res.branch_links.collect()) == sorted(links)
    # Assignment ids are dense after the existing maximum (none here: start 1).
    ids = sorted(r[0] for r in res.assignments.select("id").collect())
    assert ids == list(range(1, len(ids) + 1))


def _simple(spark, target, batch, branches=((1, 0),), collation="UNICODE_CI_AI", on_error="reject"):
    t, b, br, ty = _frames(spark, target, batch, set(branches))
    return upsert_entities(t, b, ty, br, collation=collation, on_error=on_error)


def _ent(i, name, qb, tenant=0):
    return dict(id=i, name=name, email="", phone="", note="keep", type=None, qb_id=qb, tenant_id=tenant,
                is_intrinsic=False, ntn=None, address="")


def _row(pos, name, qb, type_="Customer", tenant=0, branch=1, batch_no=0, note=None):
    return dict(batch_no=batch_no, tenant_id=tenant, pos=pos, name=name, email=None, phone=None, address=None,
                note=note, qb_id=qb, type=type_, branch_id=branch)


def test_match_ignores_type(spark):
    """Rule 2: a vendor row with a customer's external id updates it and adds
    no assignment."""
    res = _simple(spark, [_ent(1, "Cust", "7")], [_row(0, "Vend", "7", type_="Vendor", batch_no=1)])
    assert [r["name"] for r in res.entities.collect()] == ["Vend"]
    assert res.assignments.count() == 0


def test_checks_only_for_inserts(spark):
    """Rule 3: an unknown branch is fine for an update, rejected for an insert."""
    res = _simple(spark, [_ent(1, "A", "7")], [_row(0, "A2", "7", branch=99), _row(1, "B", "8", branch=99)])
    assert sorted(r["name"] for r in res.entities.collect()) == ["A2"]
    assert [r["reason"] for r in res.rejects.collect()] == ["Branch ID 99 does not exist for tenant 0"]


def test_bad_row_then_good_row_same_id(spark):
    """A rejected first row must not hide a later good row of the same id."""
    res = _simple(spark, [_ent(1, "A", "x")],
                  [_row(0, "first", "9", type_="Nope"), _row(1, "second", "9"), _row(2, "third", "9", type_="Nope")])
    new = [r for r in res.entities.collect() if r["qb_id"] == "9"]
    assert [(r["id"], r["name"]) for r in new] == [(2, "third")]
    assert [r["pos"] for r in res.rejects.collect()] == [0]


def test_sync_clears_notes_and_keeps_absent_rows(spark):
    """Rules 4 and 5: missing text overwrites with ''; rows absent from the
    source stay untouched."""
    res = _simple(spark, [_ent(1, "A", "7"), _ent(2, "B", "8")], [_row(0, "A", "7")])
    got = {r["qb_id"]: r["note"] for r in res.entities.collect()}
    assert got == {"7": "", "8": "keep"}


def test_two_rows_with_one_external_id(spark):
    """J3 updates every row with the key; here both would get one name, which
    breaks (name, tenant) uniqueness, so the change is rejected (the source
    system's UPDATE fails on the same key)."""
    res = _simple(spark, [_ent(1, "A", "7"), _ent(2, "B", "7")], [_row(0, "C", "7")])
    assert sorted(r["name"] for r in res.entities.collect()) == ["A", "B"]
    assert res.rejects.count() == 1
    res2 = _simple(spark, [_ent(1, "A", "7"), _ent(2, "B", "7", tenant=1)], [_row(0, "C", "7")])
    assert sorted(r["name"] for r in res2.entities.collect()) == ["B", "C"]


def test_null_ids_always_insert(spark):
    res = _simple(spark, [_ent(1, "A", None)], [_row(0, "N1", None), _row(1, "N2", ""), _row(2, "N3", None)])
    assert res.entities.where(F.col("qb_id").isNull()).count() == 4
    assert sorted(r["id"] for r in res.inserted.collect()) == [2, 3, 4]


def test_name_clash_rejected_case_and_accent_insensitive(spark):
    """Rule 7: an insert whose name equals an existing one under the default
    collation is rejected; binary collation lets it through."""
    target = [_ent(1, "Café Ali", "1")]
    batch = [_row(0, "CAFE ALI", "2"), _row(1, "Other", "3")]
    res = _simple(spark, target, batch)
    assert sorted(r["name"] for r in res.entities.collect()) == ["Café Ali", "Other"]
    assert [r["reason"] for r in res.rejects.collect()] == ['Duplicate entry "CAFE ALI" for key (name, tenant_id)']
    res2 = _simple(spark, target, batch, collation=None)
    assert res2.entities.count() == 3


def test_name_clash_within_batch_first_wins(spark):
    res = _simple(spark, [_ent(1, "A", "1")], [_row(0, "Same", "2"), _row(1, "same", "3")])
    assert sorted(r["qb_id"] for r in res.entities.collect()) == ["1", "2"]
    assert [r["pos"] for r in res.rejects.collect()] == [1]


def test_rejected_rename_cascades(spark):
    """A rejected rename keeps its old name, which can clash in turn."""
    target = [_ent(1, "A", "1"), _ent(2, "B", "2")]
    # row 0 renames 1: A -> B (clashes with unchanged B), row 1 inserts 'A'
    # (free only if the rename went through) -> both rejected.
    res = _simple(spark, target, [_row(0, "B", "1"), _row(1, "A", "3")])
    assert sorted(r["name"] for r in res.entities.collect()) == ["A", "B"]
    assert sorted(r["pos"] for r in res.rejects.collect()) == [0, 1]


def test_fail_mode(spark):
    with pytest.raises(UpsertError):
        _simple(spark, [_ent(1, "A", "1")], [_row(0, "B", "2", type_="Nope")], on_error="fail")


def test_collapse_batch_last_wins(spark):
    b = spark.createDataFrame([(0, 0, 0, "x", None, None, None, None, "7", None, None),
                               (0, 0, 1, "y", None, None, None, None, "7", None, None),
                               (0, 0, 2, "z", None, None, None, None, "", None, None)], BATCH_SCHEMA)
    got = sorted(((r["qb_id"], r["name"], r["n_rows"]) for r in collapse_batch(b).collect()), key=repr)
    assert got == [("7", "y", 2), (None, "z", 1)]


def test_generic_upsert_and_insert_ignore(spark):
    tgt = spark.createDataFrame([("k1", "1", "one", "x"), ("k2", "2", "two", "y")],
                                "name string, qb_id string, qb_name string, extra string")
    src = spark.createDataFrame([("k1", "10", "ten", 1), ("k1", "11", "eleven", 2), ("k3", "3", "three", 1)],
                                "name string, qb_id string, qb_name string, seq int")
    out = upsert(tgt, src, ["name"], ["qb_id", "qb_name"], order_col="seq")
    assert sorted(tuple(r) for r in out.collect()) == [("k1", "11", "eleven", "x"), ("k2", "2", "two", "y"),
                                                       ("k3", "3", "three", None)]
    ig = insert_ignore(tgt.drop("extra"), src.drop("seq").union(spark.createDataFrame([("k3", "4", "four")], "name string, qb_id string, qb_name string")).withColumn("seq", F.col("qb_id").cast("int")),
                       ["name"], order_col="seq")
    assert sorted(tuple(r) for r in ig.collect()) == [("k1", "1", "one"), ("k2", "2", "two"), ("k3", "3", "three")]


def test_hot_key_collapses_map_side(spark):
    """A third of the batch on one external id: the collapse is a partial
    aggregation (no window, no per-group collect) and keeps the last row."""
    n = 3000
    b = spark.range(n).select(
        F.lit(0).alias("batch_no"), F.lit(1).alias("tenant_id"), F.col("id").alias("pos"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string")).alias("qb_id"))
    out = collapse_batch(b)
    hot = out.where(F.col("qb_id") == "HOT").first()
    assert (hot["name"], hot["n_rows"], hot["first_pos"]) == (f"n{n - 3}", n // 3, 0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan and "collect_list" not in plan


def test_type_lookup_follows_collation(spark):
    res = _simple(spark, [_ent(1, "A", "1")], [_row(0, "B", "2", type_="customer")])
    assert [r["type"] for r in res.assignments.collect()] == [1]
    res2 = _simple(spark, [_ent(1, "A", "1")], [_row(0, "B", "2", type_="customer")], collation=None)
    assert [r["reason"] for r in res2.rejects.collect()] == ['Entity type "customer" not found in entity_types']


def test_rename_swap_succeeds(spark):
    """Rule 8: A<->B renames in one batch fail row by row in the source
    system but succeed set-based (accepted divergence)."""
    res = _simple(spark, [_ent(1, "A", "1"), _ent(2, "B", "2")], [_row(0, "B", "1"), _row(1, "A", "2")])
    assert sorted((r["qb_id"], r["name"]) for r in res.entities.collect()) == [("1", "B"), ("2", "A")]
    assert res.rejects.count() == 0
