"""Source divergence audit: how far each source's use of words is from the other sources' and from its language's.

Strings come last.  A task turns its texts into 64-bit digests of terms and adds up (group, digest) pairs before
anything is shuffled; all counting, the choice of kept terms, the probabilities, the distances and the cut to the first
terms work on fixed-width rows.  Only then

* each kept digest gets the smallest and the largest string that stand behind it, a task naming a term once.  Where
  the two differ, terms have collided: their digests are counted anew with a second digest beside the first;
* the text is joined to the terms that are in the result.

A group (language and source) is a 64-bit number too; a seed is taken under which no two groups have the same.

Distances between all sources of a language are asked for, each over all kept terms.  They are summed from tiles: the
sources of a language are dealt to tiles and its terms to blocks, and a task compares two tiles over one block.  A
term that neither source uses adds the same amount for each such term, so only cells with a count travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import U64, Scratch, mix, rows_of, single, slices, text_buffers

#: Documents of its language that a kept term is in; smoothing; scale of a probability; ranks of part `term`.
LEAST_DOCS, SMOOTH, SCALE, FIRST = 30, 5, 1_000_000_000, 50
#: Text bytes in hand; (group, digest) pairs that a task adds up before it passes them on; strings it remembers.
BYTES, POOL, KNOWN = 1 << 20, 1 << 20, 1 << 19
#: Sources in a tile, cells in a block, terms of a block in hand.
TILE, CELLS, COLUMNS = 256, 1 << 16, 256
#: So many kept digests are sent to the tasks that look for strings (8 bytes each); more are joined instead.
SENT = 1 << 21

_IS_TERM = np.zeros(256, bool)
_IS_TERM[0x41:0x5B] = _IS_TERM[0x61:0x7B] = _IS_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with a blank after each row; starts, ends and rows of the terms in it."""
    raw = np.insert(_LOWER[data], off[1:], 0x20)
    edge = np.flatnonzero(np.diff(_IS_TERM[raw].view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]  # the last byte is a blank, so every term ends
    return raw, starts, ends, np.searchsorted(off[1:] + np.arange(1, len(off)), starts, "right")


def digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit digest of each term: the sum of a number for each of its bytes and places."""
    size = ends - starts
    last = np.cumsum(size)
    place = np.arange(last[-1] if len(last) else 0) - np.repeat(last - size, size)
    byte = raw[np.repeat(starts, size) + place].astype(U64)
    run = np.concatenate([np.zeros(1, U64), np.cumsum(mix((place.astype(U64) << U64(8) | byte) * U64(2) + U64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))])
    return mix(run[last] - run[last - size] + size.astype(U64))


def _sum_by(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def _terms(b: pa.RecordBatch, bits: int):
    """Per slice of a batch (grp, text): groups of its rows, bytes, starts, ends, rows and digests of its terms."""
    grp = b.column(0).to_numpy(zero_copy_only=False)
    data, off = text_buffers(b.column(1))
    for i, j in slices(off, BYTES):
        raw, starts, ends, row = terms_of(data[off[i]:off[j]], off[i:j + 1] - off[i])
        yield grp[i:j], raw, starts, ends, row, digests(raw, starts, ends, 1) >> U64(64 - bits)


COUNTED = pa.schema([("grp", pa.int64()), ("digest", pa.int64()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(bits: int):
    """(grp, text) -> (grp, digest, occurrences, documents), added up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[tuple] = []
        held = 0

        def added():
            (d, g), (n, docs) = _sum_by([np.concatenate([p[k] for p in pool]) for k in (0, 1)], [np.concatenate([p[k] for p in pool]) for k in (2, 3)])
            return d, g, n, docs

        def told(d, g, n, docs):
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(d.view(np.int64)), pa.array(n), pa.array(docs)], schema=COUNTED)

        for b in batches:
            for grp, _, _, _, row, digest in _terms(b, bits):
                (d, r), (n,) = _sum_by([digest, row], [np.ones(len(row), np.int64)])
                pool.append((d, grp[r], n, np.ones(len(d), np.int64)))
                held += len(d)
                if held >= POOL:
                    pool = [added()]
                    held = len(pool[0][0])
                    if held >= POOL // 2:
                        yield told(*pool[0])
                        pool, held = [], 0
        if pool:
            yield told(*added())

    return run


def _inside(d: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    if wanted is None:
        return np.ones(len(d), bool)
    if not len(wanted):
        return np.zeros(len(d), bool)
    return wanted[np.minimum(np.searchsorted(wanted, d), len(wanted) - 1)] == d


def _strings(bits: int, wanted):
    """(grp, text) -> (digest, term) of the wanted digests, each string about once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = None if wanted is None else wanted.value
        known: set = set()
        for b in batches:
            for _, raw, starts, ends, _, digest in _terms(b, bits):
                keep = _inside(digest, want)
                starts, ends, digest = starts[keep], ends[keep], digest[keep]
                # Strings differ if their second digests do: every distinct one is seen, not one of each digest.
                second = digests(raw, starts, ends, 2)
                order = np.lexsort((second, digest))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(digest[order]) != 0) | (np.diff(second[order]) != 0)
                out = []
                for k in order[new].tolist():
                    pair = (int(digest[k]), int(second[k]))
                    if pair not in known:
                        known.add(pair)
                        out.append((k, raw[starts[k]:ends[k]].tobytes().decode()))
                if len(known) > KNOWN:
                    known.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(digest[[k for k, _ in out]].view(np.int64)), pa.array([t for _, t in out], pa.string())], names=["digest", "term"])

    return run


def _split(bits: int, wanted):
    """(grp, text) -> (grp, digest, sub, term, occurrences, documents) of the digests in which terms have collided."""
    fields = pa.schema([("grp", pa.int64()), ("digest", pa.int64()), ("sub", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = None if wanted is None else wanted.value
        for b in batches:
            for grp, raw, starts, ends, row, digest in _terms(b, bits):
                keep = _inside(digest, want)
                starts, ends, row, digest = starts[keep], ends[keep], row[keep], digest[keep]
                second = digests(raw, starts, ends, 2)
                (d, s, r), (n,) = _sum_by([digest, second, row], [np.ones(len(row), np.int64)])
                place = dict(zip(zip(digest.tolist(), second.tolist(), strict=True), range(len(row)), strict=True))
                term = [raw[starts[k]:ends[k]].tobytes().decode() for k in (place[x] for x in zip(d.tolist(), s.tolist(), strict=True))]
                if len(d):
                    yield pa.RecordBatch.from_arrays([pa.array(grp[r]), pa.array(d.view(np.int64)), pa.array(s.view(np.int64)), pa.array(term, pa.string()), pa.array(n),
                                                      pa.array(np.ones(len(d), np.int64))], schema=fields)

    return run


# ------------------------------------------------------------------ distances


def _cross(p: np.ndarray, on: np.ndarray, q: np.ndarray, also: np.ndarray, far: np.ndarray, both: np.ndarray, shared: np.ndarray) -> None:
    """Adds up, for rows s of p and t of q: |p_s - q_t| over the terms of s; the same and their number over the terms of both."""
    for s in range(len(p)):
        cols = np.flatnonzero(on[s])
        if len(cols):
            gap, common = np.abs(q[:, cols] - p[s, cols]), also[:, cols]
            far[s] += gap.sum(axis=1)
            both[s] += (gap * common).sum(axis=1)
            shared[s] += common.sum(axis=1)


PAIRS = pa.schema([("s", pa.int64()), ("t", pa.int64()), ("far", pa.int64()), ("seen", pa.int64())])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lkey, ta, tb, blk, kind, tile, grp, digest, sub, p) sorted so far: the sources of two tiles (kind 0, p: of
    a term that the source lacks) and their cells in a block of terms (kind 1) -> parts of their distances."""

    def settle(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        ta, tb = t["ta"][0].as_py(), t["tb"][0].as_py()
        kind, tile, grp, p = (t[c].to_numpy() for c in ("kind", "tile", "grp", "p"))
        terms, col = np.unique(np.rec.fromarrays([t[c].to_numpy()[kind == 1] for c in ("digest", "sub")]), return_inverse=True)
        names = {x: np.unique(grp[(kind == 0) & (tile == x)]) for x in (ta, tb)}
        zero = {x: p[kind == 0][np.array([np.flatnonzero(grp[kind == 0] == g)[0] for g in names[x]], int)] for x in (ta, tb)}
        cells = {x: [v[tile[kind == 1] == x] for v in (grp[kind == 1], col.ravel(), p[kind == 1])] for x in (ta, tb)}
        shape = (len(names[ta]), len(names[tb]))
        ab, ba = ([np.zeros(d, np.int64) for _ in range(3)] for d in (shape, shape[::-1]))
        for i in range(0, len(terms), COLUMNS):
            width, full, on = min(COLUMNS, len(terms) - i), {}, {}
            for x in {ta, tb}:
                g, c, v = cells[x]
                here = (c >= i) & (c < i + width)
                at = np.searchsorted(names[x], g[here]), c[here] - i
                full[x], on[x] = np.repeat(zero[x][:, None], width, axis=1), np.zeros((len(names[x]), width), bool)
                full[x][at], on[x][at] = v[here], True
            _cross(full[ta], on[ta], full[tb], on[tb], *ab)
            if ta != tb:
                _cross(full[tb], on[tb], full[ta], on[ta], *ba)
        if ta == tb:
            ba = ab
        own = {x: np.bincount(np.searchsorted(names[x], cells[x][0]), minlength=len(names[x])) for x in (ta, tb)}
        far = ab[0] + ba[0].T - ab[1]
        seen = own[ta][:, None] + own[tb][None, :] - ab[2]
        s, u = np.repeat(names[ta], shape[1]), np.tile(names[tb], shape[0])
        ok = s != u
        sides = [(s[ok], u[ok])] if ta == tb else [(s, u), (u, s)]
        for x, y in sides:
            out = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (x, y, far.ravel()[ok], seen.ravel()[ok])], schema=PAIRS)
            for k in range(0, len(out), 50_000):
                yield out.slice(k, 50_000)

    at, rows = None, []
    for b in batches:
        key = np.stack([b.column(c).to_numpy() for c in range(4)])
        cuts = [0, *(np.flatnonzero((np.diff(key, axis=1) != 0).any(axis=0)) + 1).tolist(), len(b)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            now = tuple(key[:, i].tolist())
            if rows and now != at:
                yield from settle(rows)
                rows = []
            at = now
            rows.append(b.slice(i, j - i))
    if rows:
        yield from settle(rows)


def _p(count: str, total: str, kept: str):
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)) in whole numbers (null if no term is kept)."""
    return F.expr(f"case when {kept} > 0 then 1 + (cast({SCALE} as decimal(19, 0)) * cast({count} + {SMOOTH} as decimal(19, 0))) div ({total} + {SMOOTH} * {kept}) end")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *, least_docs: int = LEAST_DOCS, bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank.

    A language keeps the terms (runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased) that are in at
    least ``least_docs`` of its documents.  p of a kept term in a group (lang, source) or a language is
    ``1 + floor(10**9 * (count + 5) / (N + 5 * V))``, N its occurrences of kept terms, V the number of these.  Part
    `pair`: for each other source of the language, the sum over all kept terms of ``abs(p - q)`` (0 if none is kept).
    Part `term`: the first 50 terms of the group whose p is above the language's, by the difference.  Ties go to the
    lesser string in UTF-8.  Null text, lang and source are empty strings; a repeated row is a document of its own; a
    group without terms is a group like any other; an empty table gives no rows; other columns are not read.
    ``bits``: of the first digest (fewer only to test collisions).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    src = single(docs, lang_col, source_col, text_col)
    src = src.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    seed = 0
    while True:
        names = src.select("lang", "source").distinct().withColumn("lkey", F.xxhash64(F.lit(seed), "lang")).withColumn("grp", F.xxhash64(F.lit(seed), "lang", "source"))
        groups = scratch.save(names, f"groups{seed}")
        all_, numbers, langs, keys = groups.agg(F.count(F.lit(1)), F.countDistinct("grp"), F.countDistinct("lang"), F.countDistinct("lkey")).first()
        if all_ == numbers and langs == keys:
            break
        seed += 1
    texts = src.select(F.xxhash64(F.lit(seed), "lang", "source").alias("grp"), "text")
    of_lang = groups.select("grp", "lkey")
    counts = texts.mapInArrow(_count(bits), "grp long, digest long, n long, docs long").groupBy("grp", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = scratch.save(counts.join(of_lang, "grp").withColumn("sub", F.lit(0).cast("long")), "counts")

    def kept_of(cells: DataFrame) -> DataFrame:
        some = cells.groupBy("lkey", "digest", "sub").agg(F.sum("n").alias("ln"), F.sum("docs").alias("docs"))
        return some.where(F.col("docs") >= least_docs).drop("docs")

    def sent(digest: DataFrame):
        """The digests for the tasks, sorted, if they are few enough; they are joined in any case."""
        if rows_of(digest) > SENT:
            return None
        return spark.sparkContext.broadcast(np.sort(digest.toPandas()["digest"].to_numpy(np.int64).view(U64)))

    kept = scratch.save(kept_of(counts), "kept0")
    wanted = scratch.save(kept.select("digest").distinct(), "wanted")
    found = texts.mapInArrow(_strings(bits, sent(wanted)), "digest long, term string").join(wanted, "digest", "left_semi")
    found = scratch.save(found.groupBy("digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi")), "strings")
    text = found.where("lo = hi").select("digest", F.lit(0).cast("long").alias("sub"), F.col("lo").alias("term"))
    bad = scratch.save(found.where("lo <> hi").select("digest"), "bad")
    if not bad.isEmpty():
        split = texts.mapInArrow(_split(bits, sent(bad)), "grp long, digest long, sub long, term string, n long, docs long").join(bad, "digest", "left_semi")
        split = split.groupBy("grp", "digest", "sub").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("term").alias("term"))
        split = scratch.save(split.join(of_lang, "grp"), "split")
        kept = scratch.save(kept.join(bad, "digest", "left_anti").select("lkey", "digest", "sub", "ln").unionByName(kept_of(split)), "kept1")
        counts = counts.join(bad, "digest", "left_anti").select("grp", "lkey", "digest", "sub", "n").unionByName(split.select("grp", "lkey", "digest", "sub", "n"))
        text = text.unionByName(split.groupBy("digest", "sub").agg(F.min("term").alias("term")))
    cells = scratch.save(counts.select("grp", "lkey", "digest", "sub", "n").join(kept, ["lkey", "digest", "sub"]), "cells")

    by_lang = groups.groupBy("lkey").agg(F.count(F.lit(1)).alias("sources")).join(kept.groupBy("lkey").agg(F.count(F.lit(1)).alias("v"), F.sum("ln").alias("nl")), "lkey", "left")
    by_lang = by_lang.join(cells.groupBy("lkey").agg(F.count(F.lit(1)).alias("cells")), "lkey", "left").fillna(0, ["v", "nl", "cells"])
    by_lang = by_lang.select("lkey", "v", "nl", F.ceil(F.col("sources") / TILE).alias("tiles"), F.greatest(F.lit(1), F.ceil(F.col("cells") / CELLS)).alias("blocks"))
    dims = groups.join(scratch.save(by_lang, "langs"), "lkey").join(cells.groupBy("grp").agg(F.sum("n").alias("ng")), "grp", "left").fillna(0, ["ng"])
    dims = scratch.save(dims.withColumn("z", F.coalesce(_p("0", "ng", "v"), F.lit(0))).withColumn("tile", F.pmod(F.xxhash64("grp", F.lit("tile")), "tiles")), "sources")
    shape = dims.select("grp", "v", "nl", "ng", "tile", "tiles", "blocks")
    cells = cells.join(shape, "grp").withColumn("p", _p("n", "ng", "v"))

    # Part `pair`.
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    columns = ["lkey", F.least("tile", "u").alias("ta"), F.greatest("tile", "u").alias("tb"), "blk", "kind", "tile", "grp", "digest", "sub", "p"]
    zero = F.lit(0).cast("long")
    sources = dims.withColumn("u", other).withColumn("blk", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumns({"kind": F.lit(0), "digest": zero, "sub": zero, "p": F.col("z")})
    used = cells.withColumn("blk", F.pmod(F.xxhash64("digest", "sub"), "blocks")).withColumn("u", other).withColumn("kind", F.lit(1))
    met = sources.select(*columns).unionByName(used.select(*columns)).repartition("lkey", "ta", "tb", "blk").sortWithinPartitions("lkey", "ta", "tb", "blk", "kind")
    parts = met.mapInArrow(_tiles, "s long, t long, far long, seen long").groupBy("s", "t").agg(F.sum("far").alias("far"), F.sum("seen").alias("seen"))
    one = dims.select(F.col("grp").alias("s"), "lang", "source", "v", F.col("z").alias("zs"))
    two = dims.select(F.col("grp").alias("t"), F.col("source").alias("item"), F.col("z").alias("zt"))
    pairs = parts.join(one, "s").join(two, "t").withColumn("value", F.col("far") + (F.col("v") - F.col("seen")) * F.abs(F.col("zs") - F.col("zt")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    # Part `term`: the text of those that can be among the first, ties included.
    high = cells.withColumn("value", F.col("p") - _p("ln", "nl", "v")).where("value > 0").select("grp", "digest", "sub", "value")
    high = high.withColumn("at", F.rank().over(Window.partitionBy("grp").orderBy(F.desc("value")))).where(F.col("at") <= FIRST)
    high = high.join(text, ["digest", "sub"]).withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("value"), "term"))).where(F.col("rank") <= FIRST)
    terms = high.join(groups, "grp").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pairs.unionByName(terms)
