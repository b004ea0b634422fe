"""Completeness gate (S2 + T1): a run of pages is released when its page sequence is whole and free of faults.

The source system fetches a source page by page and applies nothing unless every page came back.  Here pages land in
any order and over several micro-batches; a run is all pages of one source with one ``fetch_seq``.  An arbitrary
stateful operator (``transformWithState``) keyed by source holds a descriptor of each page that has come (start, number
of records, fault or not, file): a few numbers and a path.  The page bodies stay in their landed files, so a source
that holds a third of all pages is a third of the descriptors in one task, not a third of the data.

A run is whole when it has pages 1, 1 + size, ... up to its first short page, none of them a fault.  A page that lands
again replaces the earlier one (a good one is not replaced by a fault).  When a run is released, older runs of its source are
superseded: they are forgotten, and what still comes of them is reported as a fault.  Runs without ``fetch_seq`` have
no order: the next one starts anew after each release.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyspark import schemas as S
from tallyspark.sources.pages import array_size, page_fault, parse_pages

#: What the gate lets out: kind 'page' (a released page, to be read from its file) or 'fault' (a page reported).
RELEASED = "source string, kind string, fetch_seq long, requested_start long, n long, path string, landings long, fault string"
NO_SEQ = -(2 ** 63)


def describe(pages: DataFrame, entity: str, path: Column) -> DataFrame:
    """One descriptor per landed page: source, fetch_seq, requested_start, n (records), fault, path."""
    parsed = parse_pages(pages, entity)
    return parsed.select("source", "fetch_seq", "requested_start", array_size(F.col(f"page.QueryResponse.{entity}")).cast("long").alias("n"),
                         F.substring(page_fault(entity), 1, 500).alias("fault"), path.alias("path"))


class Gate(StatefulProcessor):
    def __init__(self, page_size: int = S.PAGE_SIZE):
        self.page_size = page_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "run long, start long", "n long, fault boolean, path string, landings long")
        self.released = handle.getValueState("released", "run long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        source, came = key[0], set()
        last = self.released.get()[0] if self.released.exists() else None
        # Within a micro-batch a good landing of a page comes after its faults.
        for r in sorted(rows, key=lambda r: (r.fault is None, r.path or "")):
            run = NO_SEQ if r.fetch_seq is None else r.fetch_seq
            if r.fault is not None:
                yield self._row(source, "fault", r, r.fault)
            if last is not None and run != NO_SEQ and run <= last:
                yield self._row(source, "fault", r, "Page of a superseded run")
                continue
            if r.requested_start is None:
                if r.fault is None:
                    yield self._row(source, "fault", r, "Page without a start position")
                continue
            at = (run, r.requested_start)
            held = self.pages.getValue(at) if self.pages.containsKey(at) else None
            if held is None or held[1] or r.fault is None:
                self.pages.updateValue(at, (r.n, r.fault is not None, r.path, (held[3] if held else 0) + 1))
            came.add(run)
        for run in sorted(came):
            if self._whole(run):
                yield from self._release(source, run)

    def _row(self, source, kind, r, fault) -> Row:
        return Row(source=source, kind=kind, fetch_seq=r.fetch_seq, requested_start=r.requested_start, n=r.n, path=r.path, landings=1, fault=fault)

    def _whole(self, run: int) -> bool:
        start = 1
        while self.pages.containsKey((run, start)):
            n, fault, _, _ = self.pages.getValue((run, start))
            if fault:
                return False
            if n < self.page_size:
                return True
            start += self.page_size
        return False

    def _release(self, source: str, run: int) -> Iterator[Row]:
        start = 1
        while True:
            n, _, path, landings = self.pages.getValue((run, start))
            yield Row(source=source, kind="page", fetch_seq=None if run == NO_SEQ else run, requested_start=start, n=n, path=path, landings=landings, fault=None)
            if n < self.page_size:
                break
            start += self.page_size
        if run != NO_SEQ:
            self.released.update((run,))
        for old in [k for k in self.pages.keys() if k[0] == run or (run != NO_SEQ and k[0] != NO_SEQ and k[0] < run)]:
            self.pages.removeKey(tuple(old))


def gate(pages: DataFrame, entity: str, page_size: int = S.PAGE_SIZE) -> DataFrame:
    """A stream of landed pages -> a stream of released and faulty pages (see RELEASED)."""
    told = describe(pages, entity, F.col("_metadata.file_path"))
    return told.groupBy("source").transformWithState(Gate(page_size), RELEASED, "Append", "None")


def whole_runs(pages: DataFrame, entity: str, page_size: int = S.PAGE_SIZE) -> DataFrame:
    """The same rule over a frame of landed pages: (source, fetch_seq) of the runs that are whole and free of faults.

    Partial aggregation only: the pages up to the first short one must be as many as their starts ask for.
    """
    told = describe(pages, entity, F.lit(None).cast("string"))
    one = told.groupBy("source", "fetch_seq", "requested_start").agg(F.min(F.when(F.col("fault").isNull(), F.col("n"))).alias("n"))
    ends = one.where(F.col("n") < page_size).groupBy("source", "fetch_seq").agg(F.min("requested_start").alias("last"))
    full = one.where((F.col("n") >= page_size) & (F.col("requested_start") >= 1) & ((F.col("requested_start") - 1) % page_size == 0))
    full = full.select("source", "fetch_seq", "requested_start")
    same = (F.col("e.source") == F.col("f.source")) & F.col("e.fetch_seq").eqNullSafe(F.col("f.fetch_seq")) & (F.col("f.requested_start") < F.col("e.last"))
    met = ends.alias("e").join(full.alias("f"), same, "left").groupBy(F.col("e.source"), F.col("e.fetch_seq"), F.col("e.last")).agg(F.count("f.requested_start").alias("full"))
    return met.where((F.col("last") >= 1) & ((F.col("last") - 1) % page_size == 0) & (F.col("full") == (F.col("last") - 1) / page_size)).select("source", "fetch_seq")


def read_released(spark, released: DataFrame, schema) -> DataFrame:
    """The bodies of released pages, read from the files that hold them.

    The list of files goes through the driver, as Spark's own file source keeps the files of each micro-batch there.
    Of a page that landed several times in one file one landing is taken.
    """
    files = [r[0] for r in released.select("path").distinct().collect()]
    if not files:
        return spark.createDataFrame([], schema)
    pages = spark.read.schema(schema).json(files).withColumn("path", F.col("_metadata.file_path"))
    want = released.select(F.col("source").alias("ws"), F.col("fetch_seq").alias("wf"), F.col("requested_start").alias("wr"), F.col("path").alias("wp"), "landings")
    on = (F.col("source") == F.col("ws")) & F.col("fetch_seq").eqNullSafe(F.col("wf")) & (F.col("requested_start") == F.col("wr")) & (F.col("path") == F.col("wp"))
    met = pages.join(want, on)
    names = [f.name for f in schema.fields]
    once = met.where("landings = 1").select(*names)
    first = Window.partitionBy("source", "fetch_seq", "requested_start").orderBy(F.get_json_object("body", "$.Fault").isNotNull(), F.desc("body"))
    several = met.where("landings > 1").withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*names)
    return once.unionByName(several)
