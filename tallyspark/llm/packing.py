"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Every document is tokenised and cut: its full windows stand alone, and its rest (shorter than a window) goes
into the tightest window that still has room.  The open windows are held in a segment tree over remaining
capacity.  The rests are dealt into shards by a hash of the document, each shard packs on its own, and shards
hold a bounded number of pieces, so nothing grows with the corpus but the number of shards.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import U64, Scratch, hash_words, row_words, rows_of, single, slices, text_buffers

TOKENIZER = "word_bpe_49k.json"
WINDOW = 2048
END_ID = 1
#: Pieces that one shard packs, on average.
SHARD_PIECES = 2048
#: Chunks, and bytes of chunks and their ids, that a task remembers before it starts anew; text encoded at once.
CACHE, CACHE_BYTES = 800_000, 1 << 26
BYTES = 1 << 21
ASCII_WHITE = "\t\n\x0b\x0c\r "

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                   ("doc_tokens", pa.int64()), ("ids", pa.binary())])


class SegmentTree:
    """Over the capacities 0..size: which have an open window, and the least of those that is >= a need."""

    def __init__(self, size: int):
        self.n = 1 << size.bit_length()
        self.has = bytearray(2 * self.n)

    def set(self, i: int, on: bool) -> None:
        i += self.n
        self.has[i] = on
        while i > 1:
            i >>= 1
            on = self.has[2 * i] or self.has[2 * i + 1]
            if self.has[i] == on:
                break
            self.has[i] = on

    def least(self, i: int) -> int:
        """The least capacity >= i that has an open window, or -1."""
        has, i = self.has, i + self.n
        if has[i]:
            return i - self.n
        while i > 1:
            if not i & 1 and has[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i + (not has[2 * i])
                return i - self.n
            i >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; pieces are taken longest first, equal ones in the order given."""
    where, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, rooms, opened = SegmentTree(window), [[] for _ in range(window + 1)], 0
    for k in np.argsort(-lengths, kind="stable"):
        need = int(lengths[k])
        room = tree.least(need)
        if room < 0:
            w, room, opened = opened, window, opened + 1
        else:
            w = rooms[room].pop()
            if not rooms[room]:
                tree.set(room, False)
        where[k], at[k] = w, window - room
        left = room - need
        if left:
            rooms[left].append(w)
            if len(rooms[left]) == 1:
                tree.set(left, True)
    return where, at


#: The normaliser and the splitter for which the short way below is right (fixed values of the vocabulary file).
SPLITS = ({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
          {"type": "Sequence", "pretokenizers": [
              {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
              {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
letters_only = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def _whole_texts(tok):
    """Rows of text -> ids, each text by the whole tokenizer."""
    def encode(data: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
        texts = [data[i:j].tobytes().decode() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        ids = [np.array(e.ids, "<u4") for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        return b"".join(i.tobytes() for i in ids), np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int64)

    return encode


def _encoder(path: str):
    """Rows of text -> ids as little-endian uint32 bytes.

    No token crosses white space, so equal chunks between ASCII white space are tokenised once.  A chunk of Latin letters,
    with or without full stops and commas at its end, is one or two words to the tokenizer and goes straight to its
    merges; any other chunk goes through the whole tokenizer, special tokens in the text included.

    That way is taken only for a file that normalises and splits as SPLITS says; with any other, each whole text goes
    through its tokenizer.

    The chunks met so far, and their ids, are held packed and in the order of their hashes, so a chunk takes some 40 bytes.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    told = json.loads(tok.to_str())
    known_way = (told["normalizer"], told["pre_tokenizer"]) == SPLITS and told["model"]["type"] == "BPE" and not told["model"]["ignore_merges"] and not any(
        t["lstrip"] or t["rstrip"] or t["normalized"] or set(t["content"]) & set(ASCII_WHITE) or letters_only(t["content"]) for t in told["added_tokens"])
    if not known_way:
        return _whole_texts(tok)
    letters = letters_only
    merges = tok.model.tokenize
    # The byte-level alphabet: the characters that stand for the bytes of a Latin letter.
    as_chars = {chr(c): "".join(tok.pre_tokenizer.pre_tokenize_str(chr(c))[0][0]) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))}

    def as_bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(chunks: list[str]) -> list[bytes]:
        return [as_bytes(e.ids) for e in tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def learn(new: list[str]) -> list[bytes]:
        words: dict[str, bytes] = {}

        def word(core: str) -> bytes:
            core = core.lower()
            ids = words.get(core)
            if ids is None:
                ids = words[core] = as_bytes([t.id for t in merges(core if core.isascii() else "".join(map(as_chars.__getitem__, core)))])
            return ids

        out, rest = [b""] * len(new), []
        for k, c in enumerate(new):
            text = c.rstrip(ASCII_WHITE)
            core = text.rstrip(".,")
            if not letters(core):
                rest.append(k)
            elif len(core) == len(text):
                out[k] = word(text)
            else:
                tail = text[len(core):]
                if tail not in words:
                    words[tail] = whole([tail])[0]
                out[k] = word(core) + words[tail]
        for i in range(0, len(rest), 4096):
            for k, ids in zip(rest[i:i + 4096], whole([new[k] for k in rest[i:i + 4096]]), strict=True):
                out[k] = ids
        return out

    none = (pa.array([], pa.string()), pa.array([], pa.binary()), np.zeros(0, U64), np.zeros(0, np.int32))
    held = none  # chunks; their ids; their hashes, in order; the place of the chunk of each hash

    def find(chunks: pa.StringArray, h: np.ndarray) -> np.ndarray:
        """The place of each chunk among those held, -1 if it is not there."""
        names, _, hashes, place = held
        if not len(hashes):
            return np.full(len(chunks), -1, np.int32)
        at = place[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)]
        return np.where(pc.equal(names.take(pa.array(at)), chunks).to_numpy(zero_copy_only=False), at, np.int32(-1))

    def places(chunks: pa.StringArray) -> np.ndarray:
        """The place of each of these distinct chunks; new ones are added.  Of chunks with one hash, one is found: the
        others are added again whenever they are met."""
        nonlocal held
        data, off = text_buffers(chunks)
        h = hash_words(data, off[:-1], off[1:])
        at = find(chunks, h)
        new = np.flatnonzero(at < 0)
        if len(held[0]) + len(new) > CACHE or held[0].nbytes + held[1].nbytes > CACHE_BYTES:
            held, new = none, np.arange(len(chunks))
        if len(new):
            names, ids, hashes, place = held
            fresh = chunks.take(pa.array(new))
            at[new] = len(names) + np.arange(len(new))
            new = new[np.argsort(h[new], kind="stable")]
            into = np.searchsorted(hashes, h[new])
            held = (pa.concat_arrays([names, fresh]), pa.concat_arrays([ids, pa.array(learn(fresh.to_pylist()), pa.binary())]),
                    np.insert(hashes, into, h[new]), np.insert(place, into, at[new]))
        return at

    def encode(data: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids of all rows, and where each row's begin."""
        starts, _, first = row_words(data, off)
        if not len(starts):
            return b"", np.zeros(len(off), np.int64)
        # A chunk and the white space after it, up to the next chunk; the tokenizer drops the white space.
        chunks = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        at = places(coded.dictionary)[coded.indices.to_numpy()]
        ids = held[1].take(pa.array(at))
        coded, ends = text_buffers(ids)
        return coded.tobytes(), ends[first] // 4

    return encode


def _cut(path: str, window: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for b in batches:
            out: list[list] = [[] for _ in PIECE]
            data, off = text_buffers(b.column(1))
            docs = b.column(0).to_pylist()
            for i, j in slices(off, BYTES):
                coded, at = encode(data[off[i]:off[j]], off[i:j + 1] - off[i])
                for k in range(j - i):
                    ids = coded[4 * at[k]:4 * at[k + 1]] + end
                    n = len(ids) // 4
                    for s in range(0, n, window):
                        part = ids[4 * s:4 * (s + window)]
                        for col, v in zip(out, (docs[i + k], s, len(part) // 4, zlib.crc32(part), n, part if keep_ids else None), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PIECE, strict=True)], schema=PIECE)

    return run


def _pack(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; one shard is held at a time."""
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).combine_chunks()
            shard = t["shard"][0].as_py()
            length = t["length"].to_numpy()
            short = length < window
            where, at = best_fit_decreasing(length[short], window)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            opened = int(where.max()) + 1 if len(where) else 0
            seq[short], off[short] = where, at
            seq[~short] = opened + np.arange((~short).sum())
            used = np.bincount(seq, weights=length).astype(np.int64)
            total = used[seq]
            pad = np.where(total & (total - 1) == 0, 0, window - total)
            t = t.append_column("sequence_id", pa.array(seq + (shard << 32))).append_column("offset", pa.array(off))
            t = t.append_column("padding", pa.array(pad)).drop_columns(["shard"])
            yield from t.to_batches(max_chunksize=5000)

        for b in batches:
            t = pa.Table.from_batches([b])
            shards = t["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1), len(shards)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if j > i:
                    if held and held[0]["shard"][0].as_py() != shards[i]:
                        yield from flush()
                        held = []
                    held.append(t.slice(i, j - i))
        if held:
            yield from flush()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None,
                   window: int = WINDOW, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES,
                   keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, (ids,) sequence_id, offset, padding.

    Null and empty texts are one token (the end id).  A null id is kept as it is; rows that repeat an id are
    packed as rows of their own.  An empty table gives no rows.  Other columns are not read.  ``padding`` is what
    the piece's sequence is padded by: up to the window, and nothing where its length is a power of two.
    """
    spark, path = docs.sparkSession, tokenizer or public_tokenizers.path(TOKENIZER)
    scratch = Scratch(spark, "packing")
    src = single(docs, id_col, text_col)
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    src = src.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    pieces = src.mapInArrow(_cut(path, window, end_id, keep_ids), fields)
    if not keep_ids:
        pieces = pieces.drop("ids")
        fields = fields.removesuffix(", ids binary")
    pieces = scratch.save(pieces, "pieces")
    shards = max(1, -(-rows_of(pieces) // shard_pieces))
    # Copies of one id differ in their place in the scratch table, so a repeated id does not fill one shard.
    spread = F.xxhash64("doc_id", "start", "ids_crc32", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    dealt = pieces.select("*", F.pmod(spread, F.lit(shards)).alias("shard"))
    dealt = dealt.repartition(F.col("shard")).sortWithinPartitions("shard", F.desc("length"), "doc_id", "start")
    return dealt.mapInArrow(_pack(window), fields + ", sequence_id long, offset long, padding long")
