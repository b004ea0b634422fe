"""Exact repeated passages by a sparse suffix array.

Of all suffixes (one starts at each word) only those at minimiser positions are kept: in every run of
``MIN_WORDS`` words, the place of the least hash of ``GRAM`` consecutive words.  Two equal passages of that length
therefore keep the same places.  The kept suffixes are dealt into ranges of their leading hash and sorted there;
neighbours that agree are matches.  Each matched suffix is then extended to the left and the right: all runs of
``MIN_WORDS`` words around it that it stands for are compared, again as sorted neighbours.  The runs that repeat are
merged into spans, so a span is the union of all runs of ``MIN_WORDS`` words that occur elsewhere in the corpus.

A passage may occur in a third of all documents: every task first settles repeats among its own rows and passes on
only the first one of each, so no sorted range gets more than one row per distinct run and task batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import U64, Scratch, hash_grams, hash_words, one_by_one, row_words, single, slices, text_buffers
from tallyspark.llm.ngram_join import fragment_of

MIN_WORDS, GRAM = 50, 16
BYTES, POOL, FRAGMENT = 1 << 20, 1 << 18, 1 << 18

ENTRY = pa.schema([("frag", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("ats", pa.binary()), ("flags", pa.binary())])
ENTRY_DDL = "frag int, hashes binary, docs binary, ats binary, flags binary"
FIRST, COPIED, LATER = 0, 1, 2  # flags: alone so far; has a copy; has an earlier copy


def entries(h: np.ndarray, frag: np.ndarray, doc: np.ndarray, at: np.ndarray, flag: np.ndarray) -> pa.RecordBatch:
    """A row for each fragment; settled entries go to fragment -1."""
    order = np.lexsort((at, doc, frag))
    h, frag, doc, at, flag = (x[order] for x in (h, frag, doc, at, flag))
    cuts = np.flatnonzero(np.diff(frag)) + 1
    rows = [(int(frag[i]), h[i:j].tobytes(), doc[i:j].tobytes(), np.diff(at[i:j], prepend=0).astype(np.int32).tobytes(), flag[i:j].tobytes())
            for i, j in zip([0, *cuts], [*cuts, len(h)], strict=True) if j > i]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, ENTRY, strict=True)], schema=ENTRY)


def unpacked(r: dict) -> tuple[np.ndarray, ...]:
    return (np.frombuffer(r["hashes"], U64), np.frombuffer(r["docs"], np.int64),
            np.cumsum(np.frombuffer(r["ats"], np.int32), dtype=np.int64), np.frombuffer(r["flags"], np.uint8))


def settle(h: np.ndarray, doc: np.ndarray, at: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort, compare neighbours: the order, the new flags in it, and whether an entry opens its run of equals."""
    order = np.lexsort((at, doc, h))
    h, doc, at, flag = h[order], doc[order], at[order], flag[order]
    opens = np.ones(len(h), bool)
    opens[1:] = h[1:] != h[:-1]
    run = np.cumsum(opens) - 1
    n = np.bincount(run)[run] if len(h) else run
    first = np.flatnonzero(opens)[run] if len(h) else run
    later = (doc != doc[first]) | (at != at[first])
    return order, np.where(later, LATER, np.where((n > 1) | (flag > 0), COPIED, FIRST)).astype(np.uint8), opens


class Pool:
    """Entries of one task, settled among themselves before they travel."""

    def __init__(self, frags: int):
        self.frags, self.parts, self.held = frags, [], 0

    def add(self, h, by, doc, at) -> Iterator[pa.RecordBatch]:
        self.parts.append((h, by, doc, at))
        self.held += len(h)
        if self.held >= POOL:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        h, by, doc, at = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),) * 2
        self.parts, self.held = [], 0
        order, flag, opens = settle(h, doc, at, np.zeros(len(h), np.uint8))
        h, by, doc, at = h[order], by[order], doc[order], at[order]
        return entries(h, np.where(opens, fragment_of(by, self.frags), -1).astype(np.int32), doc, at, flag)


def runs_of_words(b: pa.RecordBatch, min_words: int, gram: int) -> Iterator[tuple]:
    """Per slice of rows: word hashes, row of each word, first word of each row, hashes of the grams, starts of the
    runs of min_words words within one row, and the minimiser place of each."""
    data, off = text_buffers(b.column(1))
    for i, j in slices(off, BYTES):
        part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
        s, e, first = row_words(part, o)
        w = hash_words(part, s, e)
        row = np.repeat(np.arange(j - i), np.diff(first))
        if len(w) < min_words:
            continue
        g = hash_grams(w, gram)
        start = np.flatnonzero(row[min_words - 1:] == row[:len(w) - min_words + 1])
        span, low = min_words - gram + 1, np.empty(len(start), np.int64)
        view = np.lib.stride_tricks.sliding_window_view(g, span)
        for x in range(0, len(start), 50_000):
            low[x:x + 50_000] = view[start[x:x + 50_000]].argmin(axis=1)
        yield i, w, row, first, g, start, start + low


def _suffixes(frags: int, min_words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(frags)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, _, row, first, g, _, place in runs_of_words(b, min_words, gram):
                p = np.unique(place)
                yield from pool.add(g[p], g[p], ids[i + row[p]], p - first[row[p]])
        yield pool.flush()

    return run


def _windows(frags: int, min_words: int, gram: int):
    """Columns doc_id, text, places of the matched suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(frags)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, w, row, first, g, start, place in runs_of_words(b, min_words, gram):
                matched = np.zeros(len(w) + 1, bool)
                for r, ats in enumerate(b.column(2).slice(i, len(first) - 1)):
                    at = first[r] + np.asarray(ats.values.to_numpy(zero_copy_only=False), np.int64)
                    matched[at[at < first[r + 1]]] = True
                keep = matched[place]
                s, p = start[keep], place[keep]
                yield from pool.add(hash_grams(w, min_words)[s], g[p], ids[i + row[s]], s - first[row[s]])
        yield pool.flush()

    return run


def _by_fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    at, held = None, []
    for b in batches:
        for r in one_by_one(b):
            if held and r["frag"] != at:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held = []
            at = r["frag"]
            held.append(unpacked(r))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


RUN = pa.schema([("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("later", pa.bool_())])
RUN_DDL = "doc_id long, first int, last int, later boolean"


def runs(doc: np.ndarray, at: np.ndarray, flag: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Repeated places, as runs of neighbouring places of one document."""
    order = np.lexsort((at, doc))
    doc, at, later = doc[order], at[order], flag[order] == LATER
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1) | (later[1:] != later[:-1])
    i = np.flatnonzero(new)
    j = np.append(i[1:], len(doc)) - 1 if len(doc) else i
    b = pa.RecordBatch.from_arrays([pa.array(doc[i], pa.int64()), pa.array(at[i], pa.int32()), pa.array(at[j], pa.int32()), pa.array(later[i])], schema=RUN)
    for k in range(0, len(b), 50_000):
        yield b.slice(k, 50_000)


PLACES = pa.schema([("doc_id", pa.int64()), ("ats", pa.list_(pa.int32()))])
PLACES_DDL = "doc_id long, ats array<int>"


def places(doc: np.ndarray, at: np.ndarray, flag: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Repeated places, one row for each document."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    i = np.flatnonzero(np.diff(doc, prepend=doc[:1] - 1)) if len(doc) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(i, len(doc)).astype(np.int32)), pa.array(at.astype(np.int32)))
    b = pa.RecordBatch.from_arrays([pa.array(doc[i], pa.int64()), lists], schema=PLACES)
    for k in range(0, len(b), 50_000):
        yield b.slice(k, 50_000)


def _compare(told):
    """Fragments sorted by frag -> what repeats in them (as ``runs`` or as ``places``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, doc, at, flag in _by_fragment(batches):
            order, flag, _ = settle(h, doc, at, flag)
            some = flag > FIRST
            yield from told(doc[order][some], at[order][some], flag[some])

    return run


def _settled(told):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in one_by_one(b):
                yield from told(*unpacked(r)[1:])

    return run


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _minus(spans: list[tuple[int, int]], keep: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, b in spans:
        for x, y in keep:
            if y <= a or x >= b:
                continue
            if x > a:
                out.append((a, x))
            a = max(a, y)
            if a >= b:
                break
        if a < b:
            out.append((a, b))
    return out


SPANS_DDL = "doc_id long, n_spans long, repeated_words long, cut_words long, spans array<struct<start:int,end:int>>, cuts array<struct<start:int,end:int>>"


def _spans(min_words: int):
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                all_ = _merge([(r["first"], r["last"] + min_words) for r in found])
                cut = _minus(_merge([(r["first"], r["last"] + min_words) for r in found if r["later"]]),
                             _merge([(r["first"], r["last"] + min_words) for r in found if not r["later"]]))
                as_dicts = [[{"start": x, "end": y} for x, y in s] for s in (all_, cut)]
                for col, v in zip(out, (doc, len(all_), sum(y - x for x, y in all_), sum(y - x for x, y in cut), *as_dicts), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, span) for c in out[4:])],
                                             names=["doc_id", "n_spans", "repeated_words", "cut_words", "spans", "cuts"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = MIN_WORDS,
                      gram: int = GRAM) -> DataFrame:
    """One row per document that holds a repeated passage of at least min_words words.

    spans: word ranges [start, end) that also occur elsewhere (in another document, or again in this one).
    cuts: those parts of them to remove so that one whole copy of every passage stays, in the document with the
    least id.  Words are runs of bytes other than 0x20 and 0x09-0x0D and compare exactly.

    Documents without a repeated passage have no row; nor have null, empty and short texts.  Rows with a null id
    take no part.  Rows that repeat an id are copies of one another and have one row.  Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "suffix-dedup")
    src = single(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def dealt(packed: DataFrame, frags: int, told, ddl: str) -> DataFrame:
        own = packed.where("frag >= 0").repartition(frags, F.col("frag")).sortWithinPartitions("frag").mapInArrow(_compare(told), ddl)
        return own.unionByName(packed.where("frag < 0").mapInArrow(_settled(told), ddl))

    frags = max(8, -(-int(size / 5 * 2 / (min_words - gram + 2)) // FRAGMENT))
    kept = scratch.save(src.mapInArrow(_suffixes(frags, min_words, gram), ENTRY_DDL), "suffixes")
    matched = scratch.save(dealt(kept, frags, places, PLACES_DDL), "matched")
    scratch.drop("suffixes")
    found_at = matched.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    n = matched.agg(F.sum(F.size("ats"))).first()[0] or 0
    frags = max(8, -(-int(n * (min_words - gram + 2) / 2) // FRAGMENT))
    windows = scratch.save(src.join(found_at, "doc_id").select("doc_id", "text", "ats").mapInArrow(_windows(frags, min_words, gram), ENTRY_DDL), "windows")
    found = scratch.save(dealt(windows, frags, runs, RUN_DDL), "runs")
    scratch.drop("windows", "matched")
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "later")).alias("found")).mapInArrow(_spans(min_words), SPANS_DDL)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, cuts -> text without those words and the white space after them."""
    for b in batches:
        out = []
        for text, cuts in zip(b.column("text").to_pylist(), b.column("_cuts").to_pylist(), strict=True):
            if cuts:
                data = np.frombuffer(text.encode(), np.uint8)
                start = row_words(data, np.array([0, len(data)]))[0]
                at, kept = 0, []
                for c in cuts:
                    kept.append(data[at:start[c["start"]]].tobytes())
                    at = start[c["end"]] if c["end"] < len(start) else len(data)
                kept.append(data[at:].tobytes())
                text = b"".join(kept).decode().strip()
            out.append(text)
        yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string()))


def cut_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """documents (doc_id, text, ...) with the cuts of ``found`` taken out, and n_chars, if there, set anew for those cut.

    A document left without words goes.
    """
    cuts = found.where("cut_words > 0").select("doc_id", F.col("cuts").alias("_cuts"))
    both = docs.join(cuts, "doc_id", "left").select(*docs.columns, "_cuts")
    done = both.mapInArrow(_remove, both.schema)
    done = done.where(F.col("_cuts").isNull() | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.drop("_cuts")
