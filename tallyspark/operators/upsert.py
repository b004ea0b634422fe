"""Upserts and table mutation (U1-U6, U8, U10, U11; J1-J3).

The source system applies a JSON array of entities one row at a time with a
stored procedure.  Here the same outcome is computed set-based:

* U2 (collapse): rows of one (tenant, external id) collapse to one change.
  The last row's text wins; for an insert, type and branch come from the
  group's first *valid* row (the row that inserts; later rows only update).
* J3 (match): a group whose key exists in the target updates every target row
  with that key; NULL external ids never match and always insert.
* J1/J2 (checks): type and branch are checked for inserts only, branch first.
  Invalid rows before a group's first valid row are rejected with the source
  system's message; later rows are updates and need no check.
* U10: new ids follow the order (batch_no, tenant_id, seq, pos).
* Every batch row gets a unique ``row_key`` when the batch is materialised.  It alone identifies a row: sources of
  one tenant may repeat positions, and no row is lost or counted twice for that.
* Rule: names are unique per tenant under a case- and accent-insensitive
  collation.  ``on_error='reject'`` drops clashing changes into the rejects
  (a rejected rename keeps its old name, which may clash in turn: see
  ``_name_clashes``); ``'fail'`` raises.

Every aggregation is partial (map-side) and keyed on (tenant, external id);
NULL ids never enter a keyed shuffle.  Chosen divergences from the source
system: a JSON null id stays NULL; errors reject rows (or fail the whole job)
instead of aborting halfway; a type error inserts nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.operators.ids import assign_ids, next_id

TEXT_COLS = ["name", "email", "phone", "address", "note"]
KEYS = ["tenant_id", "qb_id"]
BATCH_COLS = ["batch_no", "tenant_id", "pos", *TEXT_COLS, "qb_id", "type", "branch_id"]
# Order of the rows of a batch: a later fetch (seq) comes after an earlier one, whatever the position in its page.
ORDER = ["batch_no", "seq", "pos"]


class UpsertError(RuntimeError):
    pass


@dataclass
class UpsertResult:
    entities: DataFrame      # the whole new entities table
    assignments: DataFrame   # new entity_assignments rows
    branch_links: DataFrame  # new entity_branch_assignments rows
    rejects: DataFrame       # batch rows not applied, with a reason
    inserted: DataFrame      # inserted entities with their source position
    stats: DataFrame         # per (tenant_id, type): fetched / inserted / updated / rejected


# ---------------------------------------------------------------------------
# Batch preparation (U11 + the NULL/'' rules of the procedure)
# ---------------------------------------------------------------------------

def combine_batches(*batches: DataFrame) -> DataFrame:
    """Customer and vendor jobs as one tagged batch (each carries its own
    batch_no, type, tenant_id, branch_id)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def prepare_batch(batch: DataFrame) -> DataFrame:
    """Absent text becomes ''; a blank external id becomes NULL."""
    cols = set(batch.columns)
    return batch.select(
        (F.col("batch_no") if "batch_no" in cols else F.lit(0)).cast("int").alias("batch_no"),
        F.col("tenant_id").cast("int").alias("tenant_id"),
        F.col("pos").cast("long").alias("pos"),
        F.coalesce(F.col("seq") if "seq" in cols else F.lit(None), F.lit(0)).cast("long").alias("seq"),
        *[F.coalesce(F.col(c).cast("string") if c in cols else F.lit(None).cast("string"), F.lit("")).alias(c)
          for c in TEXT_COLS],
        F.nullif(F.col("qb_id").cast("string"), F.lit("")).alias("qb_id"),
        (F.col("type") if "type" in cols else F.lit(None)).cast("string").alias("type"),
        (F.col("branch_id") if "branch_id" in cols else F.lit(None)).cast("int").alias("branch_id"),
    )


def collapse_batch(batch: DataFrame) -> DataFrame:
    """U2 without checks: one row per (tenant_id, qb_id) with the last row's
    text and the first row's position; NULL-id rows are all kept.

    A partial aggregation (max/min of structs), so a hot id is combined
    map-side instead of landing in one task."""
    b = prepare_batch(batch)
    keyed = (b.where(F.col("qb_id").isNotNull())
             .groupBy(*KEYS)
             .agg(F.max(F.struct(*ORDER, *TEXT_COLS)).alias("_last"),
                  F.min(F.struct(*ORDER)).alias("_first"),
                  F.count(F.lit(1)).alias("n_rows")))
    keyed = keyed.select(*KEYS, *[F.col("_last")[c].alias(c) for c in TEXT_COLS],
                         F.col("_first.batch_no").alias("batch_no"), F.col("_first.pos").alias("first_pos"),
                         F.col("_last.pos").alias("last_pos"), "n_rows")
    nulls = b.where(F.col("qb_id").isNull()).select(
        "tenant_id", "qb_id", *TEXT_COLS, "batch_no", F.col("pos").alias("first_pos"),
        F.col("pos").alias("last_pos"), F.lit(1).cast("long").alias("n_rows"))
    return keyed.unionByName(nulls)


# ---------------------------------------------------------------------------
# Checks (J1, J2)
# ---------------------------------------------------------------------------

def _type_lookup(types: DataFrame, collation: str | None) -> DataFrame:
    # Duplicate names: lowest id (made-deterministic form of the procedure's
    # LIMIT 1).  Names compare under the collation (the source database's
    # default is case-insensitive).  No hint: AQE measures the caller's frame.
    return (types.groupBy(_name_key(F.col("name"), collation).alias("_tk"))
            .agg(F.min("id").cast("int").alias("type_id")))


def check_inserts(rows: DataFrame, types: DataFrame, branches: DataFrame,
                  collation: str | None = "UNICODE_CI_AI") -> DataFrame:
    """Add type_id, _ok and reason (branch checked first, then type)."""
    br = (branches.select(F.col("id").cast("int").alias("branch_id"), F.col("tenant_id").cast("int").alias("tenant_id"))
          .dropDuplicates(["branch_id", "tenant_id"]).withColumn("_branch_ok", F.lit(True)))
    # branches is not bounded by a domain: a plain join, so AQE broadcasts it
    # only after measuring it, and falls back to a sort-merge join otherwise.
    out = (rows.join(br, ["branch_id", "tenant_id"], "left")
           .withColumn("_tk", _name_key(F.col("type"), collation))
           .join(_type_lookup(types, collation), ["_tk"], "left").drop("_tk"))
    branch_ok = F.coalesce(F.col("_branch_ok"), F.lit(False))
    reason = (F.when(~branch_ok, F.concat(F.lit("Branch ID "), F.coalesce(F.col("branch_id").cast("string"), F.lit("NULL")),
                                          F.lit(" does not exist for tenant "),
                                          F.coalesce(F.col("tenant_id").cast("string"), F.lit("NULL"))))
              .when(F.col("type_id").isNull(), F.concat(F.lit('Entity type "'), F.coalesce(F.col("type"), F.lit("NULL")),
                                                        F.lit('" not found in entity_types'))))
    return out.withColumn("reason", reason).withColumn("_ok", F.col("reason").isNull()).drop("_branch_ok")


# ---------------------------------------------------------------------------
# U1
# ---------------------------------------------------------------------------

def _name_key(c: Column, collation: str | None) -> Column:
    return F.collate(c, collation) if collation else c


def _resolve(target: DataFrame, rows: DataFrame, types: DataFrame, branches: DataFrame,
             collation: str | None = "UNICODE_CI_AI"):
    """rows: the prepared batch (checkpointed).  Returns (updates, inserts,
    rejects)."""
    keyed = rows.where(F.col("qb_id").isNotNull())
    nulls = rows.where(F.col("qb_id").isNull())

    # Which batch keys exist in the target.  The batch keys side is the
    # small one in an incremental sync (AQE broadcasts it, the target is not
    # shuffled); NULL ids never enter a keyed join (they would all hash to one
    # task).
    tkeys = target.where(F.col("qb_id").isNotNull()).select(*KEYS)
    bkeys = keyed.select(*KEYS).distinct()
    matched_keys = tkeys.join(bkeys, KEYS, "left_semi").distinct().withColumn("_m", F.lit(True))
    km = keyed.join(matched_keys, KEYS, "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
    # J1/J2 only for insert candidates; one resolved frame, materialised once
    # so the several outputs below share it (and a lost executor never
    # re-derives it differently).
    checked = check_inserts(km.where(~F.col("_m")).unionByName(nulls.withColumn("_m", F.lit(False))),
                            types, branches, collation)
    matched = km.where("_m").select("*", F.lit(None).cast("int").alias("type_id"), F.lit(None).cast("string").alias("reason"),
                                    F.lit(True).alias("_ok"))
    resolved = checked.unionByName(matched).checkpoint(eager=True)

    # Updates: last row of each matched group.
    updates = (resolved.where("_m").groupBy(*KEYS)
               .agg(F.max(F.struct(*ORDER, *TEXT_COLS, "row_key")).alias("_last"), F.count(F.lit(1)).alias("n_rows")))
    updates = updates.select(*KEYS, *[F.col("_last")[c].alias(c) for c in (*TEXT_COLS, *ORDER, "row_key")], "n_rows")

    # Inserts: per unmatched key, the first valid row inserts and the last
    # row's text wins.
    ku = resolved.where(~F.col("_m") & F.col("qb_id").isNotNull())
    groups = (ku.groupBy(*KEYS)
              .agg(F.min(F.when(F.col("_ok"), F.struct(*ORDER, "type", "type_id", "branch_id", "row_key")))
                   .alias("_first"),
                   F.max(F.struct(*ORDER, *TEXT_COLS)).alias("_last"),
                   F.count(F.lit(1)).alias("n_rows")))
    keyed_inserts = groups.where(F.col("_first").isNotNull()).select(
        "tenant_id", "qb_id", *[F.col("_last")[c].alias(c) for c in TEXT_COLS],
        *[F.col("_first")[c].alias(c) for c in (*ORDER, "type", "type_id", "branch_id", "row_key")])
    # Invalid rows before the first valid row of their group are rejected.
    bad = ku.where(~F.col("_ok"))
    at = F.struct(*ORDER)
    keyed_rejects = (bad.join(groups.select(*KEYS, F.struct(*[F.col("_first")[c].alias(c) for c in ORDER]).alias("_at"),
                                            F.col("_first").isNotNull().alias("_any")), KEYS, "left")
                     .where(~F.col("_any") | (at < F.col("_at")))
                     .drop("_at", "_any"))

    nu = resolved.where(F.col("qb_id").isNull())
    null_inserts = nu.where("_ok").select(*keyed_inserts.columns)
    rejects = (keyed_rejects.select(*BATCH_COLS, "reason", "row_key")
               .unionByName(nu.where(~F.col("_ok")).select(*BATCH_COLS, "reason", "row_key")))
    inserts = keyed_inserts.unionByName(null_inserts)
    return updates, inserts, rejects


def _apply(target: DataFrame, updates: DataFrame, inserted: DataFrame) -> DataFrame:
    """New entities table: updated target rows, untouched rows, new rows,
    with helper columns _old_name, _hit, _src (order and key of the source row) for the name
    check (callers select ENTITY_COLUMNS)."""
    t_null = target.where(F.col("qb_id").isNull())
    t_keyed = target.where(F.col("qb_id").isNotNull())
    u = updates.select(*KEYS, *[F.col(c).alias("_u_" + c) for c in TEXT_COLS],
                       F.struct(*ORDER, "row_key").alias("_src"), F.lit(True).alias("_hit"))
    j = t_keyed.join(u, KEYS, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    upd = j.select(
        *[F.when(hit, F.col("_u_" + c)).otherwise(F.col(c)).alias(c) if c in TEXT_COLS else F.col(c)
          for c in S.ENTITY_COLUMNS],
        F.col("name").alias("_old_name"), hit.alias("_hit"), "_src")
    keep = t_null.select(*S.ENTITY_COLUMNS, F.col("name").alias("_old_name"), F.lit(False).alias("_hit"),
                         F.lit(None).cast(upd.schema["_src"].dataType).alias("_src"))
    new = inserted.select(
        F.col("id").cast("long"), *[F.col(c) for c in ["name", "email", "phone", "note"]],
        F.lit(None).cast("string").alias("type"),  # the insert never fills entities.type
        "qb_id", "tenant_id", F.lit(False).alias("is_intrinsic"), F.lit(None).cast("int").alias("ntn"), "address",
        F.lit(None).cast("string").alias("_old_name"), F.lit(True).alias("_hit"),
        F.struct(*ORDER, "row_key").alias("_src"))
    return upd.unionByName(keep).unionByName(new)


def _name_clashes(table: DataFrame, collation: str | None, others: DataFrame | None = None) -> DataFrame | None:
    """Changes that break (name, tenant_id) uniqueness -> their source keys
    (tenant_id, qb_id, row_key) to reject; None when there is none.

    Of the changes to one name only the earliest can hold.  It is rejected if the name stays taken: by a row that
    keeps it, or by a row whose own change is rejected, which keeps its old name in turn.  So rejections travel
    backwards along chains of renames; ``_reaching`` follows whole chains by pointer jumping.  Swapped names hold.
    Only rows whose (tenant, name) a change touches are looked at; they are materialised once and grouped with a
    partial aggregation (a hot blank name never lands in one task)."""
    key, old = _name_key(F.col("name"), collation), _name_key(F.col("_old_name"), collation)
    changed = F.col("_hit") & (F.col("_old_name").isNull() | (key != old))
    t = table.select("tenant_id", "qb_id", "_src", key.alias("_nk"), old.alias("_ok"), changed.alias("_chg"))
    if others is not None:
        # Rows of the same tenants outside ``table`` (not rewritten): unchanged holders.
        t = t.unionByName(others.select("tenant_id", "qb_id", F.lit(None).cast(t.schema["_src"].dataType).alias("_src"),
                                        key.alias("_nk"), key.alias("_ok"), F.lit(False).alias("_chg")))
    touched = t.where("_chg").select("tenant_id", "_nk").distinct()
    cand = t.join(touched, ["tenant_id", "_nk"], "left_semi")
    by_name = (cand.groupBy("tenant_id", "_nk")
               .agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("_chg")).alias("_n_keep"),
                    F.min(F.when(F.col("_chg"), F.col("_src"))).alias("_win")))
    # Common case first: one aggregate job finds no clash at all.
    if by_name.where("_n > 1").isEmpty():
        return None
    names = by_name.withColumn("node", F.monotonically_increasing_id()).checkpoint(eager=True)
    c = t.where("_chg").join(names.select("tenant_id", "_nk", "node", "_n_keep", "_win"), ["tenant_id", "_nk"])
    held = names.select("tenant_id", F.col("_nk").alias("_ok"), F.col("node").alias("frees"))
    c = c.join(held, ["tenant_id", "_ok"], "left").select("tenant_id", "qb_id", F.col("_src.row_key").alias("row_key"), "node", "frees", "_n_keep",
                                                          (F.col("_src") != F.col("_win")).alias("late")).checkpoint(eager=True)
    # Several table rows with one external id take one source row's name: they clash among themselves.
    twice = c.where("not late").groupBy("node").count().where("count > 1").select("node")
    taken = names.where("_n_keep > 0").select("node").unionByName(twice).unionByName(c.where("late and frees is not null").select(F.col("frees").alias("node"))).distinct()
    moves = c.where("not late and frees is not null").select(F.col("frees").alias("node"), F.col("node").alias("to"))
    lost = _reaching(moves, taken)
    out = c.where("late").unionByName(c.where("not late").join(lost, "node", "left_semi").select(*c.columns))
    return out.select("tenant_id", "qb_id", "row_key").distinct()


def _reaching(edges: DataFrame, goal: DataFrame) -> DataFrame:
    """The nodes from which an edge path (node, to) leads to a node of ``goal``, with ``goal`` itself.

    Nodes with one edge point to the end of their chain after a number of joins that is logarithmic in its length
    (each join doubles what a pointer spans; cycles lead nowhere).  Nodes with several edges end chains; they are
    taken up one after the other, which only names held by several rows need."""
    goal, edges = goal.checkpoint(eager=True), edges.distinct().checkpoint(eager=True)
    free = edges.join(goal, "node", "left_anti")
    several = free.groupBy("node").count().where("count > 1").select("node")
    ends = free.join(several, "node", "left_anti").checkpoint(eager=True)
    before = None
    while True:
        far = ends.select(F.col("node").alias("to"), F.col("to").alias("far"))
        ends = ends.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")).checkpoint(eager=True)
        moved = ends.where("moved").count()
        if moved in (0, before):  # what still moves is a cycle, or leads into one
            break
        ends, before = ends.select("node", "to"), moved
    ends = ends.select("node", "to")
    split = free.join(several, "node", "left_semi")
    split = split.join(ends.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("to")).checkpoint(eager=True)
    while True:
        new = split.join(goal.select(F.col("node").alias("to")), "to", "left_semi").select("node").distinct().join(goal, "node", "left_anti")
        if new.isEmpty():
            break
        goal = goal.unionByName(new).checkpoint(eager=True)
    return goal.unionByName(ends.join(goal.select(F.col("node").alias("to")), "to", "left_semi").select("node")).distinct()


def upsert_entities(target: DataFrame, batch: DataFrame, types: DataFrame, branches: DataFrame,
                    assignments: DataFrame | None = None, on_error: str = "reject",
                    collation: str | None = "UNICODE_CI_AI", first_new_id: int | None = None,
                    first_new_assignment_id: int | None = None,
                    name_scope: DataFrame | None = None, reserve: Callable[[int], tuple[int, int]] | None = None) -> UpsertResult:
    """U1 over a whole (possibly multi-tenant, multi-type) batch.

    batch: batch_no, tenant_id, pos, name, email, phone, address, note, qb_id,
    type, branch_id.  target: the entities table.  Returns the new table and
    its side outputs; nothing is written.

    ``target`` may be only the tenants the batch touches (matching and name
    uniqueness are per tenant); then pass ``first_new_id`` (the table-wide
    max id + 1) so new ids stay unique.  ``name_scope`` (tenant_id, qb_id,
    name) adds rows of the batch's tenants that are not in ``target`` (other
    buckets), so name uniqueness still covers the whole tenant.  ``reserve`` is
    told the number of inserts and gives their first entity and assignment id.
    """
    if on_error not in ("reject", "fail"):
        raise ValueError("on_error must be 'reject' or 'fail'")
    # The batch feeds several joins and aggregations: materialise it once.
    rows = prepare_batch(batch).withColumn("row_key", F.monotonically_increasing_id()).checkpoint(eager=True)
    updates, inserts, rejects = _resolve(target, rows, types, branches, collation)
    if on_error == "fail":
        first = rejects.select("reason").first()
        if first is not None:
            raise UpsertError(first["reason"])
    clashes = _name_clashes(_apply(target, updates, inserts.withColumn("id", F.lit(None).cast("long"))), collation, name_scope)
    if clashes is not None:
        if on_error == "fail":
            raise UpsertError("Duplicate entry for key (name, tenant_id)")
        clashes = clashes.checkpoint(eager=True)
        dup = _rows_of_groups(rows, clashes).withColumn(
            "reason", F.concat(F.lit('Duplicate entry "'), F.col("name"), F.lit('" for key (name, tenant_id)')))
        updates, inserts, rejects = (_drop_groups(df, clashes) for df in (updates, inserts, rejects))
        rejects = rejects.unionByName(dup.select(*BATCH_COLS, "reason", "row_key"))
    rejects = rejects.select(*BATCH_COLS, "reason")

    # Ids once, when it is known which rows insert.  Assignment ids follow the same dense order as the entity ids.
    starts: list[int] = []

    def first_ids(n: int) -> int:
        if reserve is not None:
            starts.extend(reserve(n))
        else:
            starts.append(first_new_id if first_new_id is not None else next_id(target))
            starts.append(first_new_assignment_id if first_new_assignment_id is not None else next_id(assignments) if assignments is not None else 1)
        return starts[0]

    inserted = assign_ids(inserts, ["batch_no", "tenant_id", "seq", "pos", "qb_id", "row_key"], start=first_ids)
    e_start, a_start = starts
    table = _apply(target, updates, inserted)
    entities = table.select(*S.ENTITY_COLUMNS)
    assignments_out = inserted.select((F.col("id") - F.lit(e_start) + F.lit(a_start)).alias("id"),
                                      F.col("id").alias("entity"), F.col("type_id").alias("type"), "tenant_id")
    branch_links = inserted.select(F.col("id").alias("entity_id"), "branch_id")
    stats = sync_stats(rows, inserted, rejects)
    return UpsertResult(entities, assignments_out, branch_links, rejects, inserted, stats)


def _drop_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Without the rows of the given sources."""
    keyed = rows.where(F.col("qb_id").isNotNull()).join(groups.where(F.col("qb_id").isNotNull()).select(*KEYS), KEYS, "left_anti").select(*rows.columns)
    nulls = rows.where(F.col("qb_id").isNull()).join(groups.where(F.col("qb_id").isNull()).select("row_key"), "row_key", "left_anti").select(*rows.columns)
    return keyed.unionByName(nulls)


def _rows_of_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Batch rows belonging to the given sources: a keyed source is its whole
    (tenant_id, qb_id) group, a NULL-id source is one row."""
    keyed = rows.join(groups.where(F.col("qb_id").isNotNull()).select(*KEYS), KEYS, "left_semi")
    nulls = rows.where(F.col("qb_id").isNull()).join(groups.where(F.col("qb_id").isNull()).select("row_key"), "row_key", "left_semi")
    return keyed.unionByName(nulls)


def sync_stats(rows: DataFrame, inserted: DataFrame, rejects: DataFrame) -> DataFrame:
    """A3: per (tenant_id, type) fetched / inserted / updated / rejected, in
    batch-row terms (updated = fetched - inserted - rejected)."""
    told = [d.select("tenant_id", "type", *[F.lit(int(c == mine)).cast("long").alias(c) for c in ("fetched", "inserted", "rejected")])
            for mine, d in (("fetched", rows), ("inserted", inserted), ("rejected", rejects))]
    # One union and one group-by: a NULL type (or tenant) is a group like any other.
    out = reduce(DataFrame.unionByName, told).groupBy("tenant_id", "type").agg(*[F.sum(c).alias(c) for c in ("fetched", "inserted", "rejected")])
    return out.select("tenant_id", "type", "fetched", "inserted",
                      (F.col("fetched") - F.col("inserted") - F.col("rejected")).alias("updated"), "rejected")


# ---------------------------------------------------------------------------
# Generic key upserts
# ---------------------------------------------------------------------------

def dedupe_last(source: DataFrame, keys: list[str], order_col: str | None) -> DataFrame:
    """Last row per key wins (by ``order_col``); NULL keys are never
    duplicates and all stay.  A partial max-of-struct aggregation."""
    if order_col is None:
        return source
    other = [c for c in source.columns if c not in keys]
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    keyed = (source.where(~null_key).groupBy(*keys)
             .agg(F.max(F.struct(order_col, *[c for c in other if c != order_col])).alias("_w")))
    keyed = keyed.select(*keys, *[F.col("_w")[c].alias(c) for c in other])
    return keyed.unionByName(source.where(null_key).select(*keys, *other)).select(*source.columns)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str],
           order_col: str | None = None, defaults: dict | None = None) -> DataFrame:
    """U4: insert-or-update on ``keys``; matched rows take ``update_cols`` from
    the source and keep every other column; unmatched source rows insert
    (target columns missing from the source get ``defaults`` or NULL)."""
    src = dedupe_last(source, keys, order_col)
    null_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    t_keyed, t_null = target.where(~null_key), target.where(null_key)
    s_keyed, s_null = src.where(~null_key), src.where(null_key)
    u = s_keyed.select(*keys, *[F.col(c).alias("_u_" + c) for c in update_cols], F.lit(True).alias("_hit"))
    # The (deduplicated) source is usually the small side: AQE broadcasts it
    # and the target is never shuffled.  Matched keys come out of that same
    # join, so finding the inserts needs no pass over all target keys.
    j = t_keyed.join(u, keys, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    updated = j.select(*[F.when(hit, F.col("_u_" + c)).otherwise(F.col(c)).alias(c) if c in update_cols else F.col(c)
                         for c in target.columns])
    matched = j.where(hit).select(*keys).distinct()
    new_rows = s_keyed.join(matched, keys, "left_anti").unionByName(s_null, allowMissingColumns=True)
    defaults = defaults or {}
    ins = new_rows.select(*[(F.col(c) if c in new_rows.columns else F.lit(defaults.get(c))).cast(target.schema[c].dataType)
                            .alias(c) for c in target.columns])
    return updated.unionByName(t_null).unionByName(ins)


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], order_col: str | None = None) -> DataFrame:
    """Keep existing rows; new keys insert once (the first source row by
    ``order_col`` wins)."""
    src = source
    if order_col is not None:
        other = [c for c in source.columns if c not in keys]
        src = (source.groupBy(*keys).agg(F.min(F.struct(order_col, *[c for c in other if c != order_col])).alias("_w"))
               .select(*keys, *[F.col("_w")[c].alias(c) for c in other]))
    # Probe the target only for the source's keys (a semi join the source
    # side of which AQE can broadcast), not a distinct over all target keys.
    existing = target.select(*keys).join(src.select(*keys).distinct(), keys, "left_semi")
    new = src.join(existing, keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def auto_touch(old: DataFrame, new: DataFrame, keys: list[str], compare_cols: list[str], ts_col: str,
               now: Column) -> DataFrame:
    """``ts_col`` moves to ``now`` only for rows whose ``compare_cols``
    really changed (or are new); otherwise the old stamp stays.  Compare
    plaintext columns: encrypted output differs on every write."""
    o = old.select(*keys, F.struct(*compare_cols).alias("_old"), F.col(ts_col).alias("_old_ts"))
    j = new.join(o, keys, "left")
    same = F.struct(*[F.col(c) for c in compare_cols]).eqNullSafe(F.col("_old"))
    stamp = F.when(F.col("_old").isNotNull() & same, F.col("_old_ts")).otherwise(now)
    return j.withColumn(ts_col, stamp).select(*new.columns if ts_col in new.columns else [*new.columns, ts_col])
