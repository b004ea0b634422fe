"""Landed query-response pages.

A landed page is one row: ``source`` (what was fetched, e.g. 'Customer/7'),
``requested_start`` (the STARTPOSITION asked for; the response may lack it)
and ``body`` (the raw JSON response).  Pages land as JSON-lines files, one
page per line, so a page is never split across tasks and every file is read
in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyspark import schemas as S

LANDED_PAGE = StructType([
    StructField("source", StringType()),
    StructField("requested_start", LongType()),
    StructField("body", StringType()),
    # Order of the fetches of one source: of two landings of a page the later one holds.  Absent: 0.
    StructField("fetch_seq", LongType()),
])


class FaultError(RuntimeError):
    pass


def read_landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Read landed pages written by ``land_pages`` (JSON lines, explicit schema)."""
    return spark.read.schema(LANDED_PAGE).json(path)


def land_pages(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    have = [F.col(f.name) if f.name in pages.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LANDED_PAGE.fields]
    pages.select(*have).write.mode(mode).json(path)


def parse_pages(pages: DataFrame, entity: str, record=None) -> DataFrame:
    """Parse ``body`` with the page schema of ``entity`` into column ``page``."""
    return pages.withColumn("page", F.from_json("body", S.page_schema(entity, record)))


def _records(entity: str) -> Column:
    return F.col(f"page.QueryResponse.{entity}")


def explode_pages(pages: DataFrame, entity: str, record=None, keep: list[str] | None = None) -> DataFrame:
    """One row per record.  A missing or NULL array gives no rows.
    ``pos`` = requested_start + index (the record's 1-based position)."""
    keep = keep or ["source"]
    parsed = parse_pages(pages, entity, record) if "page" not in pages.columns else pages
    ex = parsed.select(*keep, "requested_start", F.posexplode(_records(entity)).alias("_idx", "_rec"))
    return ex.select(*keep, (F.col("requested_start") + F.col("_idx")).alias("pos"), "_rec.*")


def array_size(arr: Column) -> Column:
    """Elements in an array, 0 for NULL -- independent of ANSI mode (with ANSI
    off, ``size(NULL)`` is -1)."""
    return F.when(arr.isNull(), F.lit(0)).otherwise(F.size(arr))


def count_records(pages: DataFrame, entity: str, by: list[str] | None = None) -> DataFrame:
    """A1: records per source; a missing array counts 0."""
    by = by or ["source"]
    parsed = parse_pages(pages, entity) if "page" not in pages.columns else pages
    return parsed.groupBy(*by).agg(
        F.sum(array_size(_records(entity))).cast("long").alias("n_records"))


def page_fault(entity: str) -> Column:
    """Fault text of a parsed page (column ``page``): its ``Fault``, or that it is unreadable; NULL for a good page."""
    unreadable = F.concat(F.lit("Unreadable page: "), F.coalesce(F.substring("body", 1, 200), F.lit("NULL")))
    return F.coalesce(F.col("page.Fault"), F.when(F.col("page.QueryResponse").isNull(), unreadable))


def split_faults(pages: DataFrame, entity: str, mode: str = "reject", record=None,
                 status_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S3: pages carrying ``Fault``, and pages that do not parse or hold neither ``QueryResponse`` nor ``Fault``, go to
    the error side ('reject'), or make the job fail when the good side is evaluated ('fail').  With ``status_col``
    (the HTTP status of the landed response) a status outside 2xx is a fault
    too; its fault text is then the whole body."""
    parsed = parse_pages(pages, entity, record) if "page" not in pages.columns else pages
    fault = page_fault(entity)
    if status_col is not None:
        fault = F.when(~F.coalesce(status_ok(F.col(status_col)), F.lit(False)), F.coalesce(fault, F.col("body"))) \
            .otherwise(fault)
    faults = parsed.where(fault.isNotNull()).select("source", "requested_start", fault.alias("fault"))
    if mode == "reject":
        good = parsed.where(fault.isNull())
    elif mode == "fail":
        # A filter (not a projected column) so column pruning cannot drop the check.
        good = parsed.where(F.when(fault.isNotNull(), F.raise_error(F.concat(F.lit("API Error: "), fault)))
                            .otherwise(F.lit(True)))
    else:
        raise ValueError("mode must be 'reject' or 'fail'")
    return good, faults


def status_ok(status: Column) -> Column:
    """Status-class test: the first digit of the HTTP status is 2."""
    return F.substring(status.cast("string"), 1, 1) == F.lit("2")


def audit_pages(pages: DataFrame, entity: str, page_size: int = S.PAGE_SIZE) -> DataFrame:
    """One row per source checking the page sequence 1, 1+size, ... that
    ends at the first short page.

    Only partial aggregations (no window over a source, which could hold a
    third of all pages): expected pages follow from the largest start, so
    gaps = expected - distinct aligned starts.
    """
    parsed = parse_pages(pages, entity) if "page" not in pages.columns else pages
    size = array_size(_records(entity))
    st = F.col("requested_start")
    aligned = ((st - 1) % page_size == 0) & (st >= 1)
    g = parsed.select("source", st.alias("st"), size.alias("n"), aligned.alias("aligned")).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.sum("n").cast("long").alias("n_records"),
        F.min("st").alias("first_start"),
        F.max("st").alias("last_start"),
        F.count_distinct(F.when(F.col("aligned"), F.col("st"))).alias("_aligned_starts"),
        F.count_if(~F.col("aligned")).alias("n_misaligned"),
        F.max_by("n", "st").alias("_last_size"),
        F.count_if(F.col("n") < page_size).alias("_short"),
    )
    expected = F.floor((F.col("last_start") - 1) / page_size).cast("long") + 1
    return g.select(
        "source", "n_pages", "n_records", "first_start", "last_start",
        (F.col("first_start") == 1).alias("starts_at_one"),
        F.greatest(expected - F.col("_aligned_starts"), F.lit(0)).cast("long").alias("n_gaps"),
        (F.col("n_pages") - F.col("_aligned_starts")).cast("long").alias("n_overlaps"),
        (F.col("_last_size") < page_size).alias("terminated"),
        (F.col("_short") - F.when(F.col("_last_size") < page_size, 1).otherwise(0)).cast("long").alias("n_early_short"),
    )


def pack_pages(docs: DataFrame, entity: str, order_col: str = "pos", source: Column | None = None,
               page_size: int = S.PAGE_SIZE, time: str = "2024-01-01T00:00:00.000-07:00") -> DataFrame:
    """Build landed pages from records (used to land test data and demo feeds).

    ``order_col`` gives each record's 0-based position in its source; records
    are grouped by (source, position div page_size) -- at most ``page_size``
    records per group -- and a source whose last page is full gets the empty
    terminating page that the paged fetch would have received.
    """
    src = source if source is not None else F.lit(entity)
    rec_cols = [c for c in docs.columns if c not in (order_col, "_source")]
    d = docs.select(src.alias("_source"), F.col(order_col).cast("long").alias("_o"),
                    F.struct(*rec_cols).alias("_rec"))
    pages = (d.groupBy("_source", F.floor(F.col("_o") / page_size).cast("long").alias("_page"))
             .agg(F.sort_array(F.collect_list(F.struct("_o", "_rec"))).alias("_items")))
    pages = pages.select("_source", "_page", F.transform("_items", lambda x: x["_rec"]).alias("_arr"))
    last = (pages.groupBy("_source").agg(F.max_by(F.size("_arr"), "_page").alias("_n"), F.max("_page").alias("_page"))
            .where(F.col("_n") >= page_size)
            .select("_source", (F.col("_page") + 1).alias("_page"), F.lit(None).alias("_arr")))
    arr_type = pages.schema["_arr"].dataType
    pages = pages.unionByName(last.withColumn("_arr", F.array().cast(arr_type)))
    start = F.col("_page") * page_size + 1
    body = F.to_json(F.struct(
        F.struct(F.col("_arr").alias(entity), start.alias("startPosition"), F.size("_arr").cast("long").alias("maxResults"))
        .alias("QueryResponse"),
        F.lit(time).alias("time")))
    return pages.select(F.col("_source").alias("source"), start.alias("requested_start"), body.alias("body"))


def fault_body(message: str, code: str = "500") -> Column:
    return F.to_json(F.struct(
        F.struct(F.array(F.struct(F.lit(message).alias("Message"), F.lit(code).alias("code"))).alias("Error"),
                 F.lit("SERVICE").alias("type")).alias("Fault"),
        F.lit("2024-01-01T00:00:00.000-07:00").alias("time")))
