"""Chat formatting as a prefix tree.

Conversations that start with the same turns share them: every distinct prefix of turns is one node, and its tokens
are emitted once.  Nodes are laid out depth-first, so a node's ancestors come before it; each node carries the
position id of its first token (as if its conversation stood alone) and the intervals of the layout that its tokens
may attend to: its ancestors' and its own.

The layout is global and distributed: a node's key (the heads of the branches on its path, then its depth) sorts
depth-first, nodes are range-partitioned by it, and only one sum per partition goes through the driver.  A first turn
shared by a third of all conversations is one node with many branches; the branches lie in many partitions.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  The two marks are token ids of their own, which no text can give.
In the text form a backslash is put between ``<`` and ``|`` (behind any backslashes there), so no text holds a mark.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, single

RANKS = "byte_bpe_50k.tiktoken"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
_OPENS, _CLOSED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _OPENS.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _CLOSED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    role, _, text = formatted.removeprefix(OPEN).removesuffix(f"{CLOSE}\n").partition("\n")
    return unescape_role(role), unescape(text)


def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    n = max(ranks.values()) + 1
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={OPEN: n, CLOSE: n + 1})


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, len(b), 500):
            yield from zip(*(c.slice(i, 500).to_pylist() for c in b.columns), strict=True)


_TURN = pa.schema([("conv_id", pa.int64()), ("idx", pa.int32()), ("node", pa.string()), ("parent", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order of conversation: each prefix is named by a hash over its turns."""

    def rows() -> Iterator[tuple]:
        conv, idx, node = None, 0, None
        for c, role, text in _rows(batches):
            if c != conv:
                conv, idx, node = c, 0, None
            parent, raw = node, [s.encode() for s in (node or "", role, text)]
            node = hashlib.sha256(b"".join(len(r).to_bytes(8, "big") + r for r in raw)).hexdigest()[:32]
            yield c, idx, node, parent, role, text
            idx += 1

    yield from _batches(rows(), _TURN)


def _tokenise(path: str):
    fields = pa.schema([("node", pa.string()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("loss_from", pa.int32()), ("loss_to", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        marks, newline = enc.encode(OPEN + CLOSE, allowed_special="all"), enc.encode_ordinary("\n")

        def rows() -> Iterator[tuple]:
            for node, role, text in _rows(batches):
                head = [marks[0], *enc.encode_ordinary(escape_role(role) + "\n")]
                body = enc.encode_ordinary(escape(text))
                ids = [*head, *body, marks[1], *newline]
                yield node, ids, len(ids), len(head), len(head) + (len(body) if role == LEARNED_ROLE else 0)

        yield from _batches(rows(), fields, 200)

    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths (conv_id, idx, node, rep, n, n_tokens) in order -> key and first position of each node, once."""
    fields = pa.schema([("node", pa.string()), ("key", pa.string()), ("position", pa.int64()), ("n_tokens", pa.int64())])

    def rows() -> Iterator[tuple]:
        conv, at, branch, through = None, 0, "", 0
        for c, idx, node, rep, n, size in _rows(batches):
            if c != conv:
                conv, at, branch, through = c, 0, "", 0
            if idx == 0 or n < through:  # conversations part here: a new branch
                branch += "1" + node
            through = n
            if rep == c:
                yield node, f"{branch}0{idx:010d}", at, size
            at += size

    yield from _batches(rows(), fields)


def _attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths (conv_id, node, rep, start, n_tokens) in order -> the intervals each node attends to, once."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = pa.schema([("node", pa.string()), ("tree_start", pa.int64()), ("attends", span)])

    def rows() -> Iterator[tuple]:
        conv, root, spans = None, 0, []
        for c, node, rep, start, size in _rows(batches):
            if c != conv:
                conv, root, spans = c, start, []
            if spans and spans[-1]["end"] == start:
                spans[-1] = {"start": spans[-1]["start"], "end": start + size}
            else:
                spans.append({"start": start, "end": start + size})
            if rep == c:
                yield node, root, list(spans)

    yield from _batches(rows(), fields, 500)


def prefix_tree(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths).

    nodes, one row per distinct prefix of turns: node, parent, depth, tree_start and start (places of the tree's and
    the node's first token in the depth-first layout), n_tokens, position (id of the first token; the others follow),
    attends (intervals of the layout, the own one included), ids, loss_from and loss_to (range of the node's tokens
    under the loss mask: the text of an assistant turn).
    paths: conv_id, idx, node for every turn of every conversation.

    Turns are ordered by turn, then role, then text (nulls first); repeated rows are turns of their own.  A null role
    or text is an empty one.  A row without a conversation id takes no part.  Other columns are not read.
    """
    spark, path = turns.sparkSession, tokenizer or public_tokenizers.path(RANKS)
    scratch = Scratch(spark, "chat")
    src = single(turns, conv_col, turn_col, role_col, text_col)
    src = src.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("conv_id is not null")
    src = src.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    told = scratch.save(src.mapInArrow(_name, "conv_id long, idx int, node string, parent string, role string, text string"), "turns")
    paths = told.select("conv_id", "idx", "node")
    shared = scratch.save(told.groupBy("node").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n")), "shared")
    own = told.join(shared.withColumnRenamed("rep", "conv_id"), ["node", "conv_id"]).select("node", "role", "text")
    coded = scratch.save(own.mapInArrow(_tokenise(path), "node string, ids array<int>, n_tokens long, loss_from int, loss_to int"), "coded")
    sized = scratch.save(shared.join(coded.select("node", "n_tokens"), "node"), "sized")
    # Both sides come from tables, so a node on very many paths can be split.
    walk = paths.join(sized, "node").repartition("conv_id").sortWithinPartitions("conv_id", "idx").select("conv_id", "idx", "node", "rep", "n", "n_tokens")
    placed = scratch.save(walk.mapInArrow(_place, "node string, key string, position long, n_tokens long"), "placed")
    ordered = scratch.save(placed.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()), "ordered")
    before, sums = 0, []
    for r in ordered.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        sums.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(sums, "part int, before long")
    here = Window.partitionBy("part").orderBy("key")
    laid = ordered.withColumn("upto", F.sum("n_tokens").over(here)).join(F.broadcast(starts), "part")
    laid = laid.select("node", "position", "n_tokens", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"))
    laid = scratch.save(laid.join(shared.select("node", "rep"), "node"), "laid")
    walk = paths.join(laid, "node").repartition("conv_id").sortWithinPartitions("conv_id", "idx").select("conv_id", "node", "rep", "start", "n_tokens")
    seen = walk.mapInArrow(_attend, "node string, tree_start long, attends array<struct<start:long,end:long>>")
    kin = told.join(shared.withColumnRenamed("rep", "conv_id"), ["node", "conv_id"]).select("node", "parent", F.col("idx").alias("depth"))
    nodes = kin.join(laid.drop("rep"), "node").join(seen, "node").join(coded.drop("n_tokens"), "node")
    nodes = nodes.select("node", "parent", "depth", "tree_start", "start", "n_tokens", "position", "attends", "ids", "loss_from", "loss_to")
    return scratch.save(nodes, "nodes"), paths


def _read(path: str):
    fields = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)

        def rows() -> Iterator[tuple]:
            conv, n, turns, loss, loss_chars, chars = None, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            for c, ids, lo, hi in _rows(batches):
                if n and c != conv:
                    yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
                    n, turns, loss, loss_chars, chars = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                formatted = enc.decode_bytes(ids).decode()
                role, text = read_turn(formatted)
                turns.update(f"{role}\n{text}\n".encode())
                learned = unescape(enc.decode_bytes(ids[lo:hi]).decode())
                loss.update(learned.encode())
                conv, n, loss_chars, chars = c, n + 1, loss_chars + len(learned), chars + len(formatted)
            if n:
                yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        yield from _batches(rows(), fields)

    return run


def read_back(nodes: DataFrame, paths: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Per conversation, from the emitted tokens alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = paths.join(nodes.select("node", "ids", "loss_from", "loss_to"), "node").repartition("conv_id").sortWithinPartitions("conv_id", "idx")
    return rows.select("conv_id", "ids", "loss_from", "loss_to").mapInArrow(
        _read(tokenizer or public_tokenizers.path(RANKS)), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
