"""N-gram Jaccard self-join by vertical partitioning.

A document is its set of word shingles; documents with equal sets are one class from the start.  The shingles have
one global order, that of their hashes, and this order is cut into fragments.  Each fragment counts the overlap of
its own part of the sets, without seeing the rest of them; Spark sums the parts.  Sets a and b link when they share
``need(a, b) = ceil(t * (|a| + |b|) / (1 + t))`` shingles, and so at least ``ceil(t * |a|)``.

1. Who can link at all.  Each fragment counts, per class, the shingles that some other class has too.  The sums bound
   what a class can share with any one other: classes below ``ceil(t * n)`` link with nothing and go no further.
   What a task finds shared within its own pool of sets it counts itself and marks once; only the rest travels (four
   bytes each), so a shingle that very many documents hold never gathers in one fragment.
2. Pairs.  Over the classes left, each fragment counts the common shingles of every pair in lists of at most ``SHORT``
   classes, and passes longer lists on as (shingle, class) rows; a shingle that a task sees to be in a long list goes
   there straight away.  The sums per pair, with the number of long-list shingles of both as an upper bound, settle
   most pairs: ``sums >= need`` is a link, ``sums + bound < need`` is none.
3. Long lists (many near copies of one text) would give all their pairs.  Instead every long-list shingle belongs to
   one class, its pivot: the one that consists most of such shingles.  i(x, p), the shingles of x that belong to p, are
   counts per class and pivot.  A class is compared with the pivot that it shares most with, and most of a group is one
   component after that.  Two classes of different components that share no short list can then link only if
   ``min(i(x, p), i(y, p))`` and the rest of their long-list shingles reach ``need`` for a pivot p of x; those pairs
   are few, and they are all compared.
4. Pairs that sums leave open are counted over the whole sets, pair by pair.

The result is exact up to 64-bit hash collisions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import _MULT, U64, Scratch, hash_grams, hash_words, mix, one_by_one, row_words, rows_of, single, slices, text_buffers
from tallyspark.llm.components import merge

WORDS = 5
#: Longest list whose pairs are counted in its fragment.
SHORT = 24
#: Text bytes hashed at a time; shingles in a task's pool; shingles in a fragment; classes in a bucket of sums.
BYTES, POOL, FRAGMENT, BUCKET = 1 << 21, 1 << 21, 1 << 20, 1 << 19
#: So many wanted classes are sent to the tasks that read the texts (8 bytes each); more are joined instead.
SENT = 1 << 21
#: Classes of one pivot that are compared in one task.
SPLIT = 4096


def shingle_set(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, an empty one has none."""
    if len(words) >= k:
        return np.unique(hash_grams(words, k))
    if not len(words):
        return np.zeros(0, U64)
    h = (words * _MULT[10:10 + len(words)]).sum(dtype=U64) + U64(len(words)) * _MULT[30]
    return mix(np.array([h], U64))


def set_key(h: np.ndarray) -> int:
    """A 64-bit name of a set of shingles."""
    total = mix(h ^ _MULT[31]).sum(dtype=U64, keepdims=True)
    return int(mix(total + np.array([len(h)], U64) * _MULT[32]).view(np.int64)[0])


def row_sets(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Row ranges of a batch (columns: id, text, ...) with each row's shingle set."""
    data, off = text_buffers(b.column(1))
    for i, j in slices(off, BYTES):
        part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
        starts, ends, first = row_words(part, o)
        h = hash_words(part, starts, ends, lower=True)
        yield i, j, [shingle_set(h[first[r]:first[r + 1]], k) for r in range(j - i)]


def _describe(k: int):
    """Per row: id, set size, set key (null without shingles)."""
    fields = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets in row_sets(b, k):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())], schema=fields)

    return run


# ------------------------------------------------------------------ cutting sets into fragments

PACKED = pa.schema([("frag", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
PACKED_DDL = "frag int, kind int, keys binary, sizes binary, counts binary, hashes binary"
SETS, LOCAL, LONG, MARK = range(4)


def fragment_of(h: np.ndarray, frags: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(frags) >> U64(32)).astype(np.int64)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PACKED)], schema=PACKED)


def _packed(keys: np.ndarray, sizes: np.ndarray, who: np.ndarray, h: np.ndarray, frags: int, kind: int, half: bool) -> Iterator[tuple]:
    """A row for each fragment with what these sets hold there; ``half``: only the low 32 bits of a hash (the high ones
    choose the fragment)."""
    frag = fragment_of(h, frags)
    order = np.lexsort((who, frag))
    h, who, frag = h[order], who[order], frag[order]
    cuts = np.flatnonzero(np.diff(frag)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
        if j > i:
            w, c = np.unique(who[i:j], return_counts=True)
            yield (int(frag[i]), kind, keys[w].tobytes(), sizes[w].tobytes(), c.astype(np.int32).tobytes(), (h[i:j].astype(np.uint32) if half else h[i:j]).tobytes())


def _pools(k: int, wanted, settle):
    """Distinct sets of a task, in pools of about POOL shingles: settle(keys, sizes, who, hashes) gives packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = None if wanted is None else wanted.value
        seen: set[int] = set()
        pool: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            size = np.array([len(s) for s in pool.values()], np.int32)
            return _rows(list(settle(np.array(list(pool), np.int64), size, np.repeat(np.arange(len(pool)), size), np.concatenate(list(pool.values())))))

        for b in batches:
            for _, _, sets in row_sets(b, k):
                for s in sets:
                    if not len(s) or (key := set_key(s)) in seen:
                        continue
                    if want is not None and (len(want) == 0 or want[min(np.searchsorted(want, key), len(want) - 1)] != key):
                        continue
                    if len(seen) > 200_000:
                        seen = set(pool)
                    seen.add(key)
                    pool[key] = s
                    held += len(s)
                if held >= POOL:
                    yield flush()
                    pool, held = {}, 0
        if pool:
            yield flush()

    return run


def _own_shared(frags: int):
    """Pass 1: shingles that two sets of the pool hold are counted here and marked in their fragments, where the others go."""

    def settle(keys, sizes, who, h):
        u, back, n = np.unique(h, return_inverse=True, return_counts=True)
        shared = n[back] > 1
        marks = u[n > 1]
        where = fragment_of(marks, frags)  # sorted, as u is
        for i, j in zip(*(np.searchsorted(where, np.unique(where), side).tolist() for side in ("left", "right")), strict=True):
            yield (int(where[i]), MARK, b"", b"", b"", marks[i:j].astype(np.uint32).tobytes())
        c = np.bincount(who[shared], minlength=len(keys)).astype(np.int32)
        yield (int(keys[0] % frags), LOCAL, keys.tobytes(), b"", c.tobytes(), b"")
        yield from _packed(keys, sizes, who[~shared], h[~shared], frags, SETS, True)

    return settle


def _own_lists(frags: int):
    """Pass 2: shingles in more than SHORT sets of the pool are long-list rows at once, and marked in their fragment."""

    def settle(keys, sizes, who, h):
        u, back, n = np.unique(h, return_inverse=True, return_counts=True)
        long = n[back] > SHORT
        if long.any():
            # Dealt by class, not by shingle.
            part = (keys[who[long]].view(U64) % U64(frags)).astype(np.int64)
            w, g = who[long], h[long]
            for f in np.unique(part):
                at = part == f
                yield (int(f), LONG, keys[w[at]].tobytes(), sizes[w[at]].tobytes(), b"", g[at].tobytes())
            marks = u[n > SHORT]
            where = fragment_of(marks, frags)
            for f in np.unique(where):
                yield (int(f), MARK, b"", b"", b"", marks[where == f].tobytes())
        yield from _packed(keys, sizes, who[~long], h[~long], frags, SETS, False)

    return settle


def by_group(batches: Iterator[pa.RecordBatch], col: str) -> Iterator[list[dict]]:
    """Rows sorted by a column, one group at a time."""
    at, rows = None, []
    for b in batches:
        for r in one_by_one(b):
            if rows and r[col] != at:
                yield rows
                rows = []
            at = r[col]
            rows.append(r)
    if rows:
        yield rows


def _joined(rows: list[dict], col: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(r[col] for r in rows), kind)


def unpacked(rows: list[dict], kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and sizes of the fragment's sets; set number and hash of each entry, each entry once, sorted by hash and set."""
    keys, sizes, counts, h = (_joined(rows, c, t) for c, t in (("keys", np.int64), ("sizes", np.int32), ("counts", np.int32), ("hashes", kind)))
    keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
    who = np.repeat(back, counts)
    order = np.lexsort((who, h))
    who, h = who[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    return keys, sizes[first], who[new], h[new]


def _lists(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal hashes."""
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(h)))


# ------------------------------------------------------------------ pass 1: who can link

SUMS_DDL = "bucket int, kind int, keys binary, counts binary"


def _shared(buckets: int):
    """A fragment's part: per class, how many of its shingles here some other class has (packed by buckets of classes)."""

    def told(kind: int, keys: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = c > 0
        keys, c = keys[some], c[some].astype(np.int32)
        bucket = (keys.view(U64) % U64(buckets)).astype(np.int64)
        out = [(int(x), kind, keys[bucket == x].tobytes(), c[bucket == x].tobytes()) for x in np.unique(bucket)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                                             names=["bucket", "kind", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, "frag"):
            for r in rows:
                if r["kind"] == LOCAL:
                    yield from told(LOCAL, np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int32))
            sets = [r for r in rows if r["kind"] == SETS]
            if sets:
                keys, _, who, h = unpacked(sets, np.uint32)
                start, m = _lists(h)
                marks = np.unique(_joined([r for r in rows if r["kind"] == MARK], "hashes", np.uint32))
                shared = m > 1
                if len(marks):
                    shared |= marks[np.minimum(np.searchsorted(marks, h[start]), len(marks) - 1)] == h[start]
                yield from told(SETS, keys, np.bincount(who[np.repeat(shared, m)], minlength=len(keys)))

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class: the sum of the fragments' parts, and the most that a task has counted itself (of a class that several
    tasks have met, each has sent to the fragments what it did not count, so the most is enough)."""
    for rows in by_group(batches, "bucket"):
        keys, c, own = (np.concatenate(x) for x in zip(*[(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int32), np.full(len(r["keys"]) // 8, r["kind"] == LOCAL)) for r in rows], strict=True))
        keys, back = np.unique(keys, return_inverse=True)
        most = np.zeros(len(keys), np.int64)
        np.maximum.at(most, back[own], c[own])
        total = most + np.bincount(back[~own], weights=c[~own], minlength=len(keys)).astype(np.int64)
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i:i + 50_000]), pa.array(total[i:i + 50_000])], names=["key", "c"])


# ------------------------------------------------------------------ pass 2: pairs

COUNTED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("c", pa.int64())])
COUNTED_DDL = "a long, b long, na int, nb int, c long"


def _counted(a, b, na, nb, c) -> Iterator[pa.RecordBatch]:
    t = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((a, b, na, nb, c), COUNTED, strict=True)], schema=COUNTED)
    for i in range(0, len(t), 50_000):
        yield t.slice(i, 50_000)


def _overlaps(top: int):
    """Rows (a, b, sizes, common shingles here); c = -1: shingle a, in a long list, of class b."""

    def long_rows(h, keys, sizes) -> Iterator[pa.RecordBatch]:
        yield from _counted(h.view(np.int64), keys, sizes, sizes, np.full(len(h), -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_group(batches, "frag"):
            for r in rows:
                if r["kind"] == LONG:
                    yield from long_rows(np.frombuffer(r["hashes"], U64), np.frombuffer(r["keys"], np.int64), np.frombuffer(r["sizes"], np.int32))
            marks = np.unique(_joined([r for r in rows if r["kind"] == MARK], "hashes", U64))
            sets = [r for r in rows if r["kind"] == SETS]
            if not sets:
                continue
            keys, sizes, who, h = unpacked(sets, U64)
            start, m = _lists(h)
            long = m > SHORT
            if len(marks):
                long |= marks[np.minimum(np.searchsorted(marks, h[start]), len(marks) - 1)] == h[start]
            each = np.repeat(long, m)
            yield from long_rows(h[each], keys[who[each]], sizes[who[each]])
            found = []
            for size in range(2, SHORT + 1):
                s = start[(m == size) & ~long]
                if not len(s):
                    continue
                left, right = np.triu_indices(size, 1)
                for i in range(0, len(s), max(1, 500_000 // len(left))):
                    group = who[s[i:i + max(1, 500_000 // len(left)), None] + np.arange(size)]
                    x, y = group[:, left].ravel(), group[:, right].ravel()
                    big, small = np.maximum(sizes[x], sizes[y]).astype(np.int64), np.minimum(sizes[x], sizes[y]).astype(np.int64)
                    ok = 100 * small >= top * big
                    found.append(np.unique(x[ok].astype(np.int64) * len(keys) + y[ok], return_counts=True))
            if found:
                code, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                c = np.bincount(back, weights=np.concatenate([f[1] for f in found]), minlength=len(code)).astype(np.int64)
                x, y = code // len(keys), code % len(keys)
                yield from _counted(keys[x], keys[y], sizes[x], sizes[y], c)

    return run


def _whole_sets(k: int, wanted):
    """(doc_id, text) -> (key, hashes) of the wanted classes, a class once in a task."""
    fields = pa.schema([("key", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, seen = None if wanted is None else wanted.value, set()
        keys, held = [], []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([h.view(np.int64) for h in held], pa.list_(pa.int64()))], schema=fields)

        for b in batches:
            for _, _, sets in row_sets(b, k):
                for s in sets:
                    if not len(s) or (key := set_key(s)) in seen or (want is not None and (len(want) == 0 or want[min(np.searchsorted(want, key), len(want) - 1)] != key)):
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    held.append(s)
                if sum(map(len, held)) > POOL // 8:
                    yield told()
                    keys, held = [], []
        if keys:
            yield told()

    return run


def _dealt(df: DataFrame, parts: int, col: str) -> DataFrame:
    return df.repartition(parts, F.col(col)).sortWithinPartitions(col)


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = WORDS,
                             threshold: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable by links, its own included).

    A-Z are lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D.  Two documents link when
    ``100 * intersection >= threshold * union``.  Null, empty and blank texts have no shingles and link with
    nothing.  Rows that repeat a text (or a whole row) are links like any other.  A row with a null id takes no
    part and gets a null component.  An empty table gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    src = single(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = scratch.save(src.mapInArrow(_describe(k), "doc_id long, n long, key long"), "told")
    classes = scratch.save(rows.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "classes")
    known = src.where("doc_id is not null")
    count, total = classes.agg(F.count(F.lit(1)), F.sum("n")).first()
    frags = max(8, -(-(total or 0) // FRAGMENT))
    need = lambda n, m: F.ceil((F.col(n) + F.col(m)) * threshold / F.lit(100 + threshold))
    alone = lambda n: F.ceil(F.col(n) * threshold / F.lit(100))
    alike = lambda n, m: 100 * F.least(n, m) >= threshold * F.greatest(n, m)

    def texts_of(keys: DataFrame, tag: str):
        """(texts that hold the wanted classes, the keys for the tasks): a bounded broadcast, else a join."""
        keys = scratch.save(keys.distinct(), tag)
        if rows_of(keys) <= SENT:
            return known, spark.sparkContext.broadcast(np.sort(keys.toPandas()["key"].to_numpy(np.int64)))
        return known.join(classes.join(keys, "key").select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), None

    # Pass 1.
    buckets = max(8, -(-count // BUCKET))
    cut = _dealt(known.mapInArrow(_pools(k, None, _own_shared(frags)), PACKED_DDL), frags, "frag").mapInArrow(_shared(buckets), SUMS_DDL)
    shared = _dealt(cut, buckets, "bucket").mapInArrow(_sums, "key long, c long")
    alive = scratch.save(classes.join(shared, "key").where(F.col("c") >= alone("n")).select("key", "n"), "alive")
    # Pass 2.
    left, sent = texts_of(alive.select("key"), "alive-keys")
    frags = max(8, -(-(alive.agg(F.sum("n")).first()[0] or 0) // FRAGMENT))
    found = scratch.save(_dealt(left.mapInArrow(_pools(k, sent, _own_lists(frags)), PACKED_DDL), frags, "frag").mapInArrow(_overlaps(threshold), COUNTED_DDL), "found")
    long = scratch.save(found.where("c < 0").select(F.col("a").alias("token"), F.col("b").alias("key"), F.col("na").cast("long").alias("n")).distinct(), "long")
    in_long = scratch.save(long.groupBy("key").agg(F.count(F.lit(1)).alias("l")), "in-long")
    counted = found.where("c > 0").groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    for side in ("a", "b"):
        counted = counted.join(in_long.select(F.col("key").alias(side), F.col("l").alias(f"l{side}")), side, "left")
    counted = counted.withColumn("most", F.col("c") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))).where(F.col("most") >= need("na", "nb"))
    counted = scratch.save(counted.select("a", "b", (F.col("c") >= need("na", "nb")).alias("sure")), "counted")

    # Pass 3: pivots of the long lists, for the classes that can link by these alone.
    able = in_long.join(alive, "key").where(F.col("l") >= alone("n"))
    lists = scratch.save(long.select("token", "key").join(able, "key"), "lists")
    best = lists.groupBy("token").agg(F.max(F.struct((F.col("l") / F.col("n")).alias("share"), (-F.col("n")).alias("n"), "key")).alias("p"))
    held = lists.join(best.select("token", F.col("p.key").alias("p")), "token").groupBy("key", "n", "l", "p").agg(F.count(F.lit(1)).alias("i"))
    held = scratch.save(held, "held")
    nearest = held.groupBy("key", "n").agg(F.max(F.struct("i", "p")).alias("m")).select("key", "n", F.col("m.p").alias("p"))
    nearest = nearest.where("key <> p").join(alive.select(F.col("key").alias("p"), F.col("n").alias("m")), "p").where(alike("n", "m"))
    nearest = nearest.select(F.least("key", "p").alias("a"), F.greatest("key", "p").alias("b"))
    open_ = scratch.save(counted.where("not sure").select("a", "b").unionByName(nearest).distinct(), "open")
    named = open_.select(F.col("a").alias("key")).union(open_.select("b")).union(lists.select("key").distinct())
    texts, sent = texts_of(named, "named")
    sets = scratch.save(texts.mapInArrow(_whole_sets(k, sent), "key long, hashes array<long>").dropDuplicates(["key"]), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by their whole sets."""
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b")
        both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("both"))
        return both.where(100 * F.col("c") >= threshold * (F.col("both") - F.col("c"))).select("a", "b")

    links = scratch.save(counted.where("sure").select("a", "b").unionByName(verified(open_)), "links")
    labels = scratch.save(alive.select("key", F.col("key").alias("label")), "labels")
    labels = merge(labels, links, scratch, "first")
    # The rest: pairs in different components, by the numbers of their long-list shingles.  Of a class only the pivots
    # that a partner must share one of are looked at: without them, too few of its shingles are left.
    before = F.sum("i").over(Window.partitionBy("key").orderBy(F.desc("i"), "p")) - F.col("i")
    now = held.join(labels, "key")
    size = now.groupBy("p").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("least"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    now = scratch.save(now.join(size.select("p", "members", "least"), "p").withColumn("parts", F.ceil(F.col("members") / SPLIT)), "now")
    main = now.groupBy("p", "label").agg(F.count(F.lit(1)).alias("size")).groupBy("p").agg(F.max(F.struct("size", "label")).alias("m")).select("p", F.col("m.label").alias("main"))
    x = now.withColumn("before", before).where(F.col("l") - F.col("before") >= alone("n")).join(main, "p").where("label <> main")
    smallest = F.greatest(F.col("least"), alone("n"))
    x = x.where(F.col("l") >= F.ceil((F.col("n") + smallest) * threshold / F.lit(100 + threshold)))
    x = x.select("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("key").alias("x"), F.col("n").alias("nx"), F.col("l").alias("lx"), F.col("i").alias("ix"),
                 F.col("label").alias("labelx"))
    y = now.select("p", F.pmod(F.xxhash64("key"), "parts").alias("part"), F.col("key").alias("y"), F.col("n").alias("ny"), F.col("l").alias("ly"), F.col("i").alias("iy"), F.col("label").alias("labely"))
    bound = F.least("ix", "iy") + F.least(F.col("lx") - F.col("ix"), F.col("ly") - F.col("iy"))
    rest = x.join(y, ["p", "part"]).where((F.col("labelx") != F.col("labely")) & alike("nx", "ny") & (bound >= need("nx", "ny")))
    rest = scratch.save(rest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(open_, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        labels = merge(labels, scratch.save(verified(rest), "rest-links"), scratch, "rest")
    linked = labels.join(classes, "key")
    least_id = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    comp = classes.join(linked.select("key", "label").join(least_id, "label").select("key", "component_id"), "key", "left")
    comp = scratch.save(comp.select("key", F.coalesce("component_id", "rep").alias("component_id")), "components")
    size = F.col("n").alias("n_shingles")
    some = rows.where("key is not null").join(comp, "key", "left")
    some = some.select("doc_id", size, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    out = some.unionByName(rows.where("key is null").select("doc_id", size, F.col("doc_id").alias("component_id")))
    scratch.drop("found", "long", "sets", "lists", "held", "now")
    return out
