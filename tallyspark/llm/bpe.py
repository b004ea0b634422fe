"""Byte-level BPE of distinct words.

A Spark expression cuts the text by the tokenizer's pattern.  Each task numbers the distinct words it meets; the new
ones of a bundle of documents are merged together, one ranked merge in each word a step, over one array of tokens, and
every occurrence then takes its word's ids.  No text is shuffled, and what a task remembers is bounded.  Frequent words,
which every task would meet, are counted and merged once and broadcast.  Decoding joins the bytes of the ids by a Spark
expression over a literal.

The rank map is a pair of broadcast arrays, so that a look-up is two reads at known places.  A pair's value is the id
of the merged bytes, which is its rank.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, hash_words, rows_of, single, slices, text_buffers

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words that a task remembers before it starts anew; words in one bundle of documents (a longer document stands alone).
WORDS, BUNDLE = 1 << 16, 1 << 18
#: Frequent words are folded once for all tasks: at most SLOTS words of at most LONGEST bytes (this bounds the
#: broadcast), found in about SAMPLE documents.  They only save work: any word that is not among them is folded
#: where it occurs.
SLOTS, LONGEST, SAMPLE = 1 << 19, 64, 32_768
#: Longest match, in bytes, that is merged together with others, in time quadratic in it; a longer one is merged by a
#: heap.  Tokens that are merged together (this bounds the arrays).
FOLDED, TOKENS = 256, 1 << 17
#: Stands for "no merge" among the ranks of adjacent pairs; what is added to an id to make it larger than any rank.
NONE, TOKEN = 1 << 20, 1 << 21
#: Unicode White_Space, as a class of Java's patterns (fixed values).
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def rank_table(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(shift, table, places): the pair of ids with key k = left * 2**16 + right stands as k * 2**16 + merged id at
    ``table[k % places + shift[k % len(shift)]]``.

    The shifts are chosen, the fullest groups first, so that no two pairs meet: one look tells whether a pair exists.
    """
    ranks = read_ranks(path)
    if max(ranks.values()) >= 1 << 16:
        raise ValueError("a vocabulary of at most 65,536 ids is expected")
    pairs = {(ranks[w[:i]] << 16) + ranks[w[i:]]: n for w, n in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks}
    groups, places = max(7, len(pairs) // 4 | 1), len(pairs) * 3 // 2 | 1
    while True:
        by: dict[int, list[int]] = {}
        for k in pairs:
            by.setdefault(k % groups, []).append(k)
        if all(len({k % places for k in g}) == len(g) for g in by.values()):
            break
        places += 2
    taken, shift, out = bytearray(3 * places), [0] * groups, {}
    for g, keys in sorted(by.items(), key=lambda x: -len(x[1])):
        d, at = 0, [k % places for k in keys]
        while any(taken[x + d] for x in at):
            d += 1
        shift[g] = d
        for k, x in zip(keys, at, strict=True):
            taken[x + d] = 1
            out[x + d] = (k << 16) + pairs[k]
    return np.array(shift, np.int64), np.array([out.get(i, -1) for i in range(places + max(shift))], np.int64), places


def _look(left: np.ndarray, right: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of the merged pairs, NONE where there is no such merge."""
    shift, table, places = pairs
    k = (left << 16) + right
    v = table[k % places + shift[k % len(shift)]]
    return np.where(v >> 16 == k, v & 65535, NONE)


def merge_words(ids: np.ndarray, sizes: np.ndarray, merged: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """The byte ids of words, one word after another, and how many each has -> their ids when all merges are done.

    Each step makes one merge in every word that has any left: of its adjacent pairs that of least rank, of equal ones
    the leftmost.  Then it looks up the two pairs which the merged token forms.  A word of n bytes takes at most n - 1
    steps; words that are finished, and those told as ``merged``, go out.
    """
    who, total = np.flatnonzero(sizes), len(sizes)
    size, out, words = sizes[who].astype(np.int64), [ids[:0]], [who[:0]]
    rank = np.full(len(ids), NONE, np.int64)
    rank[:-1] = _look(ids[:-1], ids[1:], pairs)
    rank[np.cumsum(size) - 1] = NONE
    rank[np.repeat(merged[who], size)] = NONE
    while len(who):
        start = np.cumsum(size) - size
        least = np.minimum.reduceat(rank, start)
        live = least < NONE
        if not live.all():
            keep = np.repeat(live, size)
            out.append(ids[~keep])
            words.append(np.repeat(who[~live], size[~live]))
            ids, rank, who, size, least = ids[keep], rank[keep], who[live], size[live], least[live]
            start = np.cumsum(size) - size
        # One place in each word, so the k-th word lies k places further left when the merged pairs are one token.
        at = np.flatnonzero(rank == np.repeat(least, size))
        at, back = at[np.searchsorted(at, start)], np.arange(len(who))
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids[at], rank[at] = least, NONE
        ids, rank = ids[keep], rank[keep]
        at, start, size = at - back, start - back, size - 1
        left, right = at[at > start], at[at + 1 < start + size]
        rank[left - 1] = _look(ids[left - 1], ids[left], pairs)
        rank[right] = _look(ids[right], ids[right + 1], pairs)
    word = np.concatenate(words)
    return np.concatenate(out)[np.argsort(word, kind="stable")], np.bincount(word, minlength=total)


def fold_merges(tokens: pa.ListArray, pairs: tuple[np.ndarray, np.ndarray, int]) -> pa.ListArray:
    """The byte tokens (id + TOKEN) of each word -> its ids.  A word that starts with a negative number is merged already
    (``merge_long``)."""
    flat, n = tokens.flatten().to_numpy(), pc.list_value_length(tokens).to_numpy().astype(np.int64)
    off = np.concatenate([[0], np.cumsum(n)])
    ids, sizes = [flat[:0]], [n[:0]]
    for i, j in slices(off, TOKENS):
        part, size = flat[off[i]:off[j]], n[i:j]
        merged = np.zeros(j - i, bool)
        merged[np.searchsorted(off[i:j + 1], off[i] + np.flatnonzero(part < 0), "right") - 1] = True
        for out, x in zip((ids, sizes), merge_words(part[part >= 0] - TOKEN, size - merged, merged, pairs), strict=True):
            out.append(x)
    off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))


def merge_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long match by a heap of its pairs, where each merge touches its two neighbours only: least rank
    first, of equal ranks the leftmost."""
    n = len(raw)
    piece = [raw[i:i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(raw[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if piece[i] is not None else -1
        if j < 0 or ranks.get(piece[i] + piece[j]) != rank:
            continue  # one of the two has changed since
        piece[i], piece[j] = piece[i] + piece[j], None
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b >= 0 and (r := ranks.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (r, a))
    return [ranks[p] for p in piece if p is not None]


def decoded(ids: Column, path: str) -> Column:
    """Binary column: the bytes of the ids, joined (null for a null list or an unknown id)."""
    by_id = sorted((n, w.hex()) for w, n in read_ranks(path).items())
    # No hex digits, so that ``unhex`` of a text that holds them is null.
    unknown = "??"
    pieces = [unknown] * (by_id[-1][0] + 1)
    for n, h in by_id:
        pieces[n] = h
    t = F.split(F.lit(",".join(pieces)), ",")
    hexes = F.get(F.transform(F.array(t), lambda p: F.transform(ids, lambda i: F.get(p, i.cast("int")))), F.lit(0))
    return F.unhex(F.array_join(hexes, "", unknown))


BUNDLED = pa.schema([("docs", pa.list_(pa.int64())), ("sizes", pa.binary()), ("words", pa.binary()), ("anew", pa.bool_()), ("fresh", pa.list_(pa.list_(pa.int64())))])


def _byte_tokens(path: str) -> np.ndarray:
    ranks = read_ranks(path)
    return np.array([ranks[bytes([i])] + TOKEN for i in range(256)], np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = pc.value_counts(b.column(0).flatten())
        for i in range(0, len(n), 50_000):
            part = n.slice(i, 50_000)
            yield pa.RecordBatch.from_arrays([part.field(0), part.field(1)], names=["word", "n"])


def _coded(path: str, pairs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_token, ranks = _byte_tokens(path), read_ranks(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), fold_merges(_tokens(b.column(0), byte_token, ranks), pairs.value)], names=["word", "ids"])

    return run


def frequent_words(src: DataFrame, path: str, scratch: Scratch, pairs) -> pa.Table:
    """(word, ids) of frequent words of src (doc_id, words): of the words that share a slot the most frequent one."""
    some = max(1, rows_of(src.select("doc_id")) // SAMPLE)
    sample = src.where(F.pmod(F.xxhash64("doc_id"), F.lit(some)) == 0).select("words")
    counts = sample.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(f"n > 1 and octet_length(word) <= {LONGEST}")
    best = counts.groupBy(F.crc32(F.col("word").cast("binary")) % SLOTS).agg(F.max(F.struct("n", "word")).alias("w")).select("w.word")
    best = scratch.save(best, "frequent")
    return scratch.save(best.mapInArrow(_coded(path, pairs), "word string, ids array<int>"), "frequent-ids").toArrow().combine_chunks()


def _places(words: pa.Array):
    """A look-up of words (distinct): names -> the place of each among words, -1 for those not found.

    Words are found by their hash and then compared, so no word is a Python object.  Of words with the same hash one is
    found; the others count as not found.
    """

    def hashes(a: pa.Array) -> np.ndarray:
        data, off = text_buffers(a)
        return hash_words(data, off[:-1], off[1:])

    h = hashes(words)
    order = np.argsort(h).astype(np.int32)
    h = h[order]

    def run(names: pa.Array) -> np.ndarray:
        if not len(h):
            return np.full(len(names), -1, np.int32)
        at = order[np.minimum(np.searchsorted(h, hashes(names)), len(h) - 1)]
        return np.where(pc.equal(words.take(pa.array(at)), names).to_numpy(zero_copy_only=False), at, -1)

    return run


def _tokens(names: pa.Array, byte_token: np.ndarray, ranks: dict[bytes, int]) -> pa.ListArray:
    """The byte tokens of each name; of one of over FOLDED bytes -1 and the tokens that are left when it is merged."""
    data, off = text_buffers(names)
    tokens, n = byte_token[data], np.diff(off)
    if (n > FOLDED).any():
        parts, last = [], 0
        for i in np.flatnonzero(n > FOLDED).tolist():
            ids = merge_long(data[off[i]:off[i + 1]].tobytes(), ranks)
            parts += [tokens[last:off[i]], np.array([-1, *(x + TOKEN for x in ids)], np.int64)]
            last, n[i] = off[i + 1], len(ids) + 1
        tokens = np.concatenate([*parts, tokens[last:]])
        off = np.concatenate([[0], np.cumsum(n)])
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(tokens))


def _number(path: str, shared):
    """(id, words) -> bundles: ids, words per document, word numbers, and the byte tokens of words not met before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_token, ranks, words = _byte_tokens(path), read_ranks(path), _plain(shared.value["word"])
        frequent, find = len(words), _places(words)
        known: dict[str, int] = {}
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int32)
            for i, j in slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), BUNDLE):
                part = b.slice(i, j - i)
                values = pc.dictionary_encode(part.column(1).flatten())
                number = find(values.dictionary)
                rest = np.flatnonzero(number < 0)
                rare = values.dictionary.take(pa.array(rest))
                names = rare.to_pylist()
                fresh = [k for k, w in enumerate(names) if w not in known]
                anew = len(known) + len(fresh) > WORDS
                if anew:
                    known, fresh = {}, range(len(names))
                for k in fresh:
                    known[names[k]] = frequent + len(known)
                number[rest] = [known[w] for w in names]
                tokens = _tokens(rare.take(pa.array(fresh, pa.int32())), byte_token, ranks)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0)), pa.array([sizes[i:j].tobytes()], pa.binary()),
                    pa.array([number[values.indices.to_numpy()].tobytes()], pa.binary()), pa.array([anew]),
                    pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), tokens)], schema=BUNDLED)

    return run


def _plain(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) and col.num_chunks else pa.array([], col.type) if isinstance(col, pa.ChunkedArray) else col


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the lists, one after another, and how many each list has."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _fold(pairs):
    """Bundles with the byte tokens of the new words -> with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fresh = b.column(4)
            codes = pa.ListArray.from_arrays(fresh.offsets, fold_merges(fresh.values, pairs.value))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], codes], names=["docs", "sizes", "words", "anew", "codes"])

    return run


def _assemble(shared):
    """Bundles with the ids of the new words -> one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n = _flat(_plain(shared.value["ids"]))
        frequent, off = len(n), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        for b in batches:
            for k in range(len(b)):
                docs, sizes, words, anew, codes = (b.column(c)[k] for c in range(5))
                if anew.as_py():
                    ids, off = ids[:off[frequent]], off[:frequent + 1]
                new, n = _flat(codes.values)
                ids, off = np.concatenate([ids, new]), np.concatenate([off, off[-1] + np.cumsum(n, dtype=np.int64)])
                numbers = np.frombuffer(words.as_py(), np.int32)
                first = off[numbers]
                n = off[numbers + 1] - first
                end = np.concatenate([[0], np.cumsum(n)])
                at = np.repeat(first - end[:-1], n)
                at += np.arange(len(at))
                ends = end[np.concatenate([[0], np.cumsum(np.frombuffer(sizes.as_py(), np.int32), dtype=np.int64)])]
                yield pa.RecordBatch.from_arrays([docs.values, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[at]))], names=["doc_id", "ids"])

    return run


def java_pattern(pattern: str) -> str:
    """The pattern with \\s and \\S written out, which Java would take as ASCII."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i:i + 2]
        if c in (r"\s", r"\S"):
            out.append(SPACE if inside and c == r"\s" else f"[{'^' * (c == chr(92) + 'S')}{SPACE}]")
        elif c[0] == "\\":
            out.append(c)
        else:
            inside = c[0] == "[" or inside and c[0] != "]"
            out.append(c[0])
            i -= 1
        i += 2
    return "".join(out)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array<int>): every text encoded by the ranks, each match of the pattern by itself.

    Null and empty texts have no ids.  Rows that repeat an id, and rows with a null id, are encoded one by one; an
    empty table gives no rows; other columns are not read.  A match of up to FOLDED bytes is merged in time quadratic in
    its length, a longer one in time n log n.
    """
    path = ranks or public_tokenizers.path(RANKS)
    cut = F.lit(java_pattern(pattern or public_tokenizers.PATTERN))
    src = single(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"),
                                                F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), cut, F.lit(0)).alias("words"))
    sc = docs.sparkSession.sparkContext
    pairs = sc.broadcast(rank_table(path))
    shared = sc.broadcast(frequent_words(src, path, Scratch(docs.sparkSession, "bpe"), pairs))
    number, fold, assemble = _number(path, shared), _fold(pairs), _assemble(shared)
    return src.mapInArrow(lambda batches: assemble(fold(number(batches))), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ids_col: str = "ids", *, ranks: str | None = None) -> DataFrame:
    """The frame with a column ``decoded``: the bytes of the ids."""
    return tokens.withColumn("decoded", decoded(F.col(ids_col), ranks or public_tokenizers.path(RANKS)))
