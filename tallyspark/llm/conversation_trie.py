"""Prefix trie of conversations by range-minimum queries over sorted longest common prefixes (LCPs).

A turn is named by 16 bytes of the SHA-256 of its role and text, so a conversation is a string of names and its turns'
texts travel no further.  Conversations are sorted by that string, in range partitions (blocks).  A node of the trie
is then an interval of neighbours: the row at its left end brings the prefix in (its LCP with the row before is
shorter), and it ends where the LCP falls below the node's depth.

1. In a block, sparse tables hold the minima of the LCPs (and of the conversation ids) over all runs of 2**k rows.
   Every candidate prefix finds its right end by a binary search over them, and every row the left end of the prefix
   that it shares with the row before, which is the parent of the first node that it brings in.  All searches are
   independent of each other; there is no stack, and the sums over a node's subtree are differences of running sums.
2. Blocks meet at their edges.  A block tells its first and last string and the depth that all its rows share; the
   LCP at each edge is found in Spark, and a sparse table over blocks (a few numbers a block, the only thing that goes
   through the driver) tells for an interval that touches an edge in which block it begins.  The pieces of such
   nodes, at most two for a block and a depth, are summed by Spark.

A group of equal conversations, or of conversations that start alike, is cut at block edges like any other rows, since
the id is part of the sort key.  Its ids travel as joined chunks; only the hash over them is a stream through one
task, as SHA-256 cannot be split.  The names and text lengths of one conversation (24 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, ceil_div, single, text_buffers

NAME = 16
#: Rows and bytes of names that a block is meant to hold; nodes searched at a time; ids in a chunk.
BLOCK_ROWS, BLOCK_BYTES, SEARCHED, CHUNK = 1 << 17, 32 << 20, 1 << 18, 8192
NO_ENDS = hashlib.sha256(b"").hexdigest()

PIECE = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("l", pa.int64()), ("depth", pa.int64()), ("n", pa.int64()), ("conv", pa.int64()),
                   ("kids", pa.int64()), ("leaves", pa.int64()), ("total", pa.int64()), ("fresh", pa.int64()), ("own", pa.int64()), ("cum", pa.int64()),
                   ("left", pa.bool_()), ("right", pa.bool_()), ("pconv", pa.int64()), ("pleft", pa.bool_()), ("pright", pa.bool_()), ("ends", pa.string()),
                   ("seq", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("first_sizes", pa.list_(pa.int64()))])
PIECE_DDL = ("kind int, part int, l long, depth long, n long, conv long, kids long, leaves long, total long, fresh long, own long, cum long, left boolean, "
             "right boolean, pconv long, pleft boolean, pright boolean, ends string, seq long, first_key binary, last_key binary, first_sizes array<long>")
NODE, IDS, BLOCK = 0, 1, 2


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, key (the names of its turns, joined), sizes (UTF-8 bytes of each text).

    Turns are ordered by turn, a null one first; of several rows with one turn, by role and then text.  A null role
    or text is an empty one, repeated rows are turns of their own, a row without a conversation id takes no part.
    """
    src = single(turns, conv_col, turn_col, role_col, text_col)
    src = src.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    # Only rows that share their turn number need role and text to be ordered.
    tied = src.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("conv_id").alias("tc"), F.col("turn").alias("tt"), F.lit(True).alias("tied"))
    named = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256), 1, 2 * NAME)
    src = src.join(tied, (F.col("conv_id") == F.col("tc")) & F.col("turn").eqNullSafe(F.col("tt")), "left")
    row = F.struct("turn", F.when(F.col("tied"), F.col("role")).alias("role"), F.when(F.col("tied"), F.col("text")).alias("text"), named.alias("name"),
                   F.octet_length("text").cast("long").alias("size"))
    out = src.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    return out.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["name"]), "")).alias("key"), F.transform("t", lambda x: x["size"]).alias("sizes"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % 5 (all if fewer, none if there is no
    such conversation), h = crc32(decimal c) % 9; its own turns after its first h follow."""
    most = 8
    head = convs.where(F.col("conv_id") % 5 == 0).select(F.col("conv_id").alias("base"), F.expr(f"substring(key, 1, {most * NAME})").alias("head"),
                                                         F.slice("sizes", 1, most).alias("head_sizes"))
    own = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int"))
    own = own.join(head, "base", "left")
    return own.select("conv_id", F.expr(f"concat(substring(coalesce(head, X''), 1, {NAME} * h), substring(key, {NAME} * h + 1))").alias("key"),
                      F.expr("concat(slice(coalesce(head_sizes, array()), 1, h), slice(sizes, h + 1, size(sizes)))").alias("sizes"))


# ------------------------------------------------------------------ range minima


def sparse_table(v: np.ndarray) -> list[np.ndarray]:
    """Level k: the least of every run of 2**k values."""
    levels, w = [v], 1
    while 2 * w <= len(v):
        levels.append(np.minimum(levels[-1][:-w], levels[-1][w:]))
        w *= 2
    return levels


def right_ends(minima: list[np.ndarray], start: np.ndarray, depth: np.ndarray, least: list[np.ndarray], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last place of the run from ``start`` whose values after it all reach ``depth``; and the least of ``least``
    over the run (``low`` stands for its first place)."""
    n, at, low = len(minima[0]), start + 1, low.copy()
    for k in range(len(minima) - 1, -1, -1):
        here = np.minimum(at, len(minima[k]) - 1)
        ok = (at + (1 << k) <= n) & (minima[k][here] >= depth)
        low[ok] = np.minimum(low[ok], least[k][here[ok]])
        at = at + (ok.astype(np.int64) << k)
    return at - 1, low


def left_ends(minima: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place left of ``start`` (or it) whose value is below ``depth``; the values behind it reach it."""
    at = start.copy()
    for k in range(len(minima) - 1, -1, -1):
        lo = at - (1 << k) + 1
        ok = (lo >= 0) & (minima[k][np.clip(lo, 0, len(minima[k]) - 1)] >= depth)
        at = at - (ok.astype(np.int64) << k)
    return at


def common_prefixes(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Turns that each string shares with the one before it (-1 for the first); names: two words for a turn."""
    size = np.diff(first)
    m = np.minimum(size[:-1], size[1:])
    out = np.concatenate([[-1], m])
    end = np.cumsum(m)
    seg = np.repeat(np.arange(len(m)), m)
    within = np.arange(end[-1] if len(m) else 0) - (end - m)[seg]
    miss = np.flatnonzero((names[first[seg] + within] != names[first[seg + 1] + within]).any(axis=1))
    pair, at = np.unique(seg[miss], return_index=True)
    out[pair + 1] = within[miss[at]]
    return out


# ------------------------------------------------------------------ one block


def _pieces(cols: dict, n: int) -> pa.RecordBatch:
    """A batch of n rows; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in PIECE], schema=PIECE)


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of sorted conversations (conv_id, key, sizes) -> its nodes, the ids that end in nodes at its edges,
    and a row about the block.  The first row is taken as sharing nothing with the row before it."""
    got = [b for b in batches if len(b)]
    if not got:
        return
    part, t = TaskContext.get().partitionId(), pa.Table.from_batches(got)
    conv = t["conv_id"].to_numpy().astype(np.int64)
    data, off = text_buffers(t["key"])
    names, first = np.frombuffer(data.tobytes(), np.uint64).reshape(-1, 2), off // NAME
    bytes_ = np.concatenate([[0], np.cumsum(t["sizes"].combine_chunks().flatten().to_numpy())]).astype(np.int64)
    del got, t
    n, size = len(conv), np.diff(first)
    lcp = common_prefixes(names, first)
    after = np.append(lcp[1:], -1)
    brought = size - lcp  # nodes that a row brings in
    at = np.concatenate([[0], np.cumsum(brought)])
    upto = lambda row, depth: bytes_[first[row] + np.maximum(depth, 0)] - bytes_[first[row]]
    total = upto(np.arange(n), size)
    fresh = total - upto(np.arange(n), lcp)
    run = lambda v: np.concatenate([[0], np.cumsum(v)])
    leaves, totals, freshes = run(after < size), run(total), run(fresh)
    minima, least = sparse_table(lcp), sparse_table(conv)
    # The parent of a row's first new node is the prefix shared with the row before; it was brought in at its left end.
    rows = np.flatnonzero(brought[1:] > 0) + 1
    parent_row = np.zeros(n, np.int64)
    parent_row[rows] = left_ends(minima, rows, lcp[rows])
    parent = np.full(n, -1, np.int64)
    parent[rows] = at[parent_row[rows]] + lcp[rows] - lcp[parent_row[rows]] - 1
    children = np.bincount(parent[rows], minlength=at[-1])

    def search(i: int, j: int):
        row = np.searchsorted(at, np.arange(i, j), "right") - 1
        depth = np.arange(i, j) - at[row] + lcp[row] + 1
        return row, depth, *right_ends(minima, row, depth, least, conv[row])

    conv_of, right_of = np.empty(at[-1], np.int64), np.empty(at[-1], bool)
    for i in range(0, int(at[-1]), SEARCHED):
        j = min(i + SEARCHED, int(at[-1]))
        _, _, r, low = search(i, j)
        conv_of[i:j], right_of[i:j] = low, r == n - 1
    # Equal strings follow each other; the node where they end was brought in by the first of them.
    head = np.flatnonzero((lcp < size) | (np.arange(n) == 0))
    tail = np.append(head[1:], n)
    node_of = at[head + 1] - 1
    ends: dict[int, str] = {}
    held: dict[str, list] = {c: [] for c in ("kind", "part", "l", "depth", "right", "left", "seq", "ends")}
    for node, i, j in zip(node_of.tolist(), head.tolist(), tail.tolist(), strict=True):
        if i and not right_of[node]:
            ends[node] = hashlib.sha256(",".join(map(str, conv[i:j].tolist())).encode()).hexdigest()
            continue
        for seq, k in enumerate(range(i, j, CHUNK)):
            for c, v in zip(held, (IDS, part, i, size[i], bool(right_of[node]), i == 0, seq, ",".join(map(str, conv[k:min(k + CHUNK, j)].tolist()))), strict=True):
                held[c].append(v)
    yield _pieces(held, len(held["kind"]))
    for i in range(0, int(at[-1]), SEARCHED):
        j = min(i + SEARCHED, int(at[-1]))
        row, depth, r, low = search(i, j)
        top = depth == lcp[row] + 1
        up = np.where(top, parent[row], np.arange(i, j) - 1)
        some = up >= 0
        own = total[row] - upto(row, depth - 1)
        yield _pieces({
            "kind": np.full(j - i, NODE), "part": np.full(j - i, part), "l": row, "depth": depth, "n": r - row + 1, "conv": low,
            "kids": children[i:j] + (size[row] > depth), "leaves": leaves[r + 1] - leaves[row], "total": totals[r + 1] - totals[row],
            "fresh": freshes[r + 1] - freshes[row + 1] + own, "own": own, "cum": upto(row, depth - 1), "left": row == 0, "right": r == n - 1,
            "pconv": pa.array(conv_of[up], mask=~some), "pleft": some & (np.where(top, parent_row[row], row) == 0), "pright": some & right_of[up],
            "ends": [ends.get(x) for x in range(i, j)]}, j - i)
    whole = int(lcp[1:].min()) if n > 1 else int(size[0])
    key = lambda i: data[off[i]:off[i + 1]].tobytes()
    yield _pieces({"kind": [BLOCK], "part": [part], "n": [n], "depth": [whole], "first_key": [key(0)], "last_key": [key(n - 1)],
                   "first_sizes": [np.diff(bytes_[first[0]:first[1] + 1])]}, 1)


# ------------------------------------------------------------------ edges of blocks

EDGE = pa.schema([("part", pa.int32()), ("shared", pa.int64()), ("rest", pa.int64()), ("goes_on", pa.bool_())])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, last_key of the block before, first_key, first_sizes) -> turns shared over the edge, the text bytes of the
    first string after them, and whether the last string before the edge goes on (or stands again) behind it."""
    for b in batches:
        out = []
        for i in range(len(b)):
            part, last, key, sizes = (b.column(c)[i].as_py() for c in range(4))
            first = np.array([0, len(last) // NAME, (len(last) + len(key)) // NAME])
            shared = int(common_prefixes(np.frombuffer(last + key, np.uint64).reshape(-1, 2), first)[1])
            out.append((part, shared, sum(sizes[shared:]), shared * NAME == len(last)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), EDGE, strict=True)], schema=EDGE)


class Edges:
    """Blocks in order: their numbers, what they share with the block before (-1 for the first) and within."""

    def __init__(self, part: np.ndarray, shared: np.ndarray, rest: np.ndarray, goes_on: np.ndarray, whole: np.ndarray):
        self.part, self.shared, self.rest = part, np.append(shared, -1), rest
        self.goes_on = np.append(goes_on[1:], False)  # of the last string of a block, over its right edge
        self.through = sparse_table(np.minimum(shared, whole))

    def place(self, part: np.ndarray, left: np.ndarray, right: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The block in which a node at an edge begins if it lies in several blocks; -1 if it lies in one."""
        at = np.searchsorted(self.part, part)
        goes_left, goes_right = left & (depth <= self.shared[at]), right & (depth <= self.shared[at + 1])
        head = np.where(goes_right, self.part[at], -1)
        if goes_left.any():
            head[goes_left] = self.part[left_ends(self.through, at[goes_left] - 1, depth[goes_left])]
        return head


PLACED_DDL = ("part int, l long, depth long, n long, conv long, kids long, leaves long, total long, fresh long, cum long, left boolean, right boolean, pconv long, ends string, "
              "seq long, head int, phead int")
PLACED = ("part", "l", "depth", "n", "conv", "kids", "leaves", "total", "fresh", "cum", "left", "right", "pconv", "ends", "seq")


def _place(edges: Edges):
    """Adds head (of the node) and phead (of its parent), and takes out what the neighbouring blocks count too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))
            num = lambda c: col(c).fill_null(0).to_numpy(zero_copy_only=False)
            flag = lambda c: col(c).fill_null(False).to_numpy(zero_copy_only=False)
            part, depth, left, right = num("part"), num("depth"), flag("left"), flag("right")
            head, phead = edges.place(part, left, right, depth), edges.place(part, flag("pleft"), flag("pright"), depth - 1)
            at = np.searchsorted(edges.part, part)
            again = left & (depth <= edges.shared[at])
            fixed = {"kids": num("kids") - (left & (depth < edges.shared[at])), "leaves": num("leaves") - (right & edges.goes_on[at]),
                     "fresh": num("fresh") + np.where(again, edges.rest[at] - num("own"), 0)}
            cols = [pa.array(fixed[c]) if c in fixed else col(c) for c in PLACED]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(head.astype(np.int32)), pa.array(phead.astype(np.int32))], names=[*PLACED, "head", "phead"])

    return run


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (hp, hl, depth, ends) in order -> the hash of each node's joined chunks."""
    fields = pa.schema([("hp", pa.int32()), ("hl", pa.int64()), ("depth", pa.int64()), ("ends", pa.string())])
    node, h = None, None
    for b in batches:
        out = []
        for i in range(len(b)):
            now = tuple(b.column(c)[i].as_py() for c in range(3))
            if now != node:
                if h:
                    out.append((*node, h.hexdigest()))
                node, h = now, hashlib.sha256()
            else:
                h.update(b",")
            h.update(b.column(3)[i].as_py().encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, h.hexdigest()), fields, strict=True)], schema=fields)


def prefix_trie(convs: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row per distinct prefix (node) of the conversations (conv_id, key, sizes: see ``ordered_turns``).

    conv_id: the smallest member; depth; parent_conv_id: that of the parent (null for the root); n_convs: members;
    n_children; n_leaves: childless nodes of the subtree, itself included; saved_tokens: over the subtree, a node's
    (n_convs - 1) times the bytes of its last text; ends_sha256: hash of the ids of the members that end here,
    ascending and joined by commas.  A conversation without turns ends in the root; without any conversation there is
    no row, not even a root.  Several rows of one conv_id count as several members.
    """
    spark = convs.sparkSession
    scratch = Scratch(spark, "conversation-trie")
    rows = scratch.save(convs.select("conv_id", "key", "sizes"), "rows")
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("key"))).first()
    blocks = blocks or max(8, ceil_div(n, BLOCK_ROWS), ceil_div(size or 0, BLOCK_BYTES))
    by = rows.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = scratch.save(by.mapInArrow(_block, PIECE_DDL), "pieces")
    told = pieces.where(F.col("kind") == BLOCK).select("part", F.col("depth").alias("whole"), "first_key", "last_key", "first_sizes")
    whole = dict(told.select("part", "whole").collect())  # two numbers a block
    parts = sorted(whole)
    before = spark.createDataFrame(list(zip(parts[1:], parts, strict=False)), "part int, before int")
    met = told.select("part", "first_key", "first_sizes").join(before, "part").join(told.select(F.col("part").alias("before"), "last_key"), "before")
    edge = {r[0]: r[1:] for r in met.select("part", "last_key", "first_key", "first_sizes").mapInArrow(_edges, "part int, shared long, rest long, goes_on boolean").collect()}
    of = [edge.get(p, (-1, 0, False)) for p in parts]
    edges = Edges(np.array(parts, np.int64), np.array([e[0] for e in of], np.int64), np.array([e[1] for e in of], np.int64), np.array([e[2] for e in of], bool),
                  np.array([whole[p] for p in parts], np.int64))
    placed = lambda df: df.mapInArrow(_place(edges), PLACED_DDL)
    nodes = pieces.where(F.col("kind") == NODE)
    inner = placed(nodes.where("not left and not right")).withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS)))
    touch = scratch.save(placed(nodes.where("left or right")), "touch")
    # Ids of the members that end in nodes at an edge: key of a node that lies in one block is (block, first row).
    node_key = [F.when(F.col("head") >= 0, F.col("head")).otherwise(F.col("part")).alias("hp"), F.when(F.col("head") >= 0, F.lit(-1).cast("long")).otherwise(F.col("l")).alias("hl")]
    ids = placed(pieces.where(F.col("kind") == IDS)).select(*node_key, "depth", "ends", "part", "seq").repartition("hp", "hl", "depth").sortWithinPartitions("hp", "hl", "depth", "part", "seq")
    hashes = scratch.save(ids.select("hp", "hl", "depth", "ends").mapInArrow(_hash_ids, "hp int, hl long, depth long, ends string"), "hashes")
    begins = F.col("part") == F.col("head")
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "total", "fresh")]
    several = touch.where("head >= 0").groupBy("head", "depth").agg(F.min("conv").alias("conv"), *sums, F.max("cum").alias("cum"), F.max(F.when(begins, F.col("pconv"))).alias("pconv"),
                                                                  F.max(F.when(begins, F.col("phead"))).alias("phead"))
    several = several.withColumn("hp", F.col("head")).withColumn("hl", F.lit(-1).cast("long"))
    single_block = touch.where("head < 0").withColumn("hp", F.col("part")).withColumn("hl", F.col("l"))
    cols = ["depth", "conv", "n", "kids", "leaves", "total", "fresh", "cum", "pconv", "phead"]
    edged = several.select("hp", "hl", *cols).unionByName(single_block.select("hp", "hl", *cols))
    edged = scratch.save(edged.join(hashes, ["hp", "hl", "depth"], "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))), "edged")
    out = inner.select(*cols, "ends").unionByName(edged.select(*cols, "ends"))
    # A parent over several blocks has its smallest member among all of them: few such nodes, looked up by a join.
    above = edged.where("hl < 0").select(F.col("hp").alias("phead"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("above"))
    out = out.where("phead < 0").withColumn("up", F.col("pconv")).unionByName(out.where("phead >= 0").join(above, ["phead", "depth"], "left").withColumn("up", F.col("above")).drop("above"))
    return out.select(F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("up")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
                      F.col("leaves").alias("n_leaves"), (F.col("total") - F.col("n") * F.col("cum") - F.col("fresh")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
