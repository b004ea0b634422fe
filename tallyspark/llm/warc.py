"""WARC archives: one gzip member per record, and a reader that splits files at any byte.

Writing: every task writes one archive of its pages to the shared folder under a name of its own and reports it; a
repeated task writes another archive, and only reported archives are read.

Reading: a split is a byte range of one archive.  Its task looks for the gzip magic from the start of the range on
and takes a candidate for a record only if a whole member decodes there (with its checksum) and starts with WARC
headers, however long they are.  From then on member follows member.  A split owns the records that start inside it, and reads past its end
to finish the last one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, rows_of, single

MAGIC = b"\x1f\x8b\x08"
SPLIT, BLOCK = 64 << 20, 1 << 18
LEVEL = 4
#: Fixed by the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DDL = "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"
RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(urn: str | None) -> int | None:
    n = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def _one_line(s: str) -> str:
    return s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(s: str) -> str:
    return s.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, revisits: int | None, date: str) -> bytes:
    """One gzip member.  A revisit carries no payload, but the digest and length of the whole one."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if revisits is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if revisits is not None:
        head += [f"WARC-Refers-To: {_urn(revisits)}", f"WARC-Profile: {PROFILE}", f"X-Payload-Length: {len(payload)}"]
    block = payload if revisits is None else b""
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _write(root: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns page_id, url, payload text, revisits."""
        out, n, size = None, 0, 0
        for b in batches:
            for page_id, url, text, revisits in zip(*(b.column(i) for i in range(4)), strict=True):
                if out is None:
                    fs, path = pyarrow.fs.FileSystem.from_uri(root)
                    fs.create_dir(path, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                data = record(page_id.as_py(), url.as_py(), (text.as_py() or "").encode(), revisits.as_py(), date)
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["name", "bytes", "records"])

    return run


def write_warc(pages: DataFrame, root: str, scratch: Scratch, *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
               min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives under root (a folder that all executors see); returns (name, bytes, records) of each.

    Of records with equal payloads of at least min_bytes bytes the one with the largest id is the response (each of
    them, if rows repeat that id), the others revisit it.  A null text is an empty payload, a null id an empty one.
    """
    src = single(pages, id_col, url_col, text_col).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                                                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("html"))
    src = src.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    equal = src.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    # Saved, so that both sides of the join are dealt out anew and a payload held by many pages can be split.
    equal = scratch.save(equal.where("n > 1").select("sha", "size", "last"), "equal-payloads")
    known = src.join(equal, ["sha", "size"], "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("revisits"))
    return scratch.save(known.mapInArrow(_write(root, date), "name string, bytes long, records long"), "archives")


class _Bytes:
    """Reads of one archive through a window that only moves forward (or a little back)."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, pos: int, n: int) -> bytes:
        end = min(pos + n, self.size)
        if pos < self.at or end > self.at + len(self.data):
            self.file.seek(pos)
            self.at, self.data = pos, self.file.read(min(max(n, BLOCK), self.size - pos))
        return self.data[pos - self.at:end - self.at]


def _headers(raw: bytes) -> dict[str, str] | None:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        return None
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        out[name.strip().lower()] = value.strip()
    return out if out.get("content-length", "").isdigit() and "warc-type" in out else None


def member(src: _Bytes, pos: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, block and end of the record whose gzip member starts at pos; None if none does."""
    z, out, at, head, seen = zlib.decompressobj(31), [], pos, None, bytearray()
    try:
        while not z.eof:
            chunk = src.get(at, BLOCK if head else 4096)
            if not chunk:
                return None
            part = z.decompress(chunk)
            at += len(chunk) - len(z.unused_data)
            if head is None:
                tried = max(0, len(seen) - 3)
                seen += part
                if not b"WARC/1.".startswith(seen[:7]) and not seen.startswith(b"WARC/1."):
                    return None
                cut = seen.find(b"\r\n\r\n", tried)
                if cut >= 0:
                    head = _headers(bytes(seen[:cut]))
                    if head is None:
                        return None
                    out.append(bytes(seen[cut + 4:]))
            else:
                out.append(part)
    except zlib.error:
        return None
    if head is None:
        return None
    n = int(head["content-length"])
    block = b"".join(out)
    return (head, block[:n], at) if len(block) >= n else None


def records(src: _Bytes, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records that start in [start, end)."""
    pos = start
    while pos < end:
        found = member(src, pos) if src.get(pos, 3) == MAGIC else None
        if found:
            yield found[0], found[1]
            pos = found[2]
            continue
        pos += 1
        while pos < end:
            chunk = src.get(pos, BLOCK)
            i = chunk.find(MAGIC)
            if i >= 0:
                pos += i
                break
            if len(chunk) < 3:
                return
            pos += len(chunk) - 2


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns name, size, start, end."""
        fs, path = pyarrow.fs.FileSystem.from_uri(root)
        for b in batches:
            for name, size, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held = [], 0
                with fs.open_input_file(f"{path}/{name}") as f:
                    for head, block in records(_Bytes(f, size), start, end):
                        kind, revisit = head["warc-type"], head["warc-type"] == "revisit"
                        uri = head.get("warc-target-uri")
                        rows.append((_id(head.get("warc-record-id")), kind, None if uri is None else _unline(uri), int(head["x-payload-length"]) if revisit else len(block),
                                     head["warc-payload-digest"].removeprefix("sha1:") if revisit else digest(block), _id(head.get("warc-refers-to")), None if revisit else block))
                        held += len(block)
                        if held > 1 << 22 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)

    return run


def read_warc(spark: SparkSession, root: str, archives: DataFrame, *, split_bytes: int = SPLIT) -> DataFrame:
    """page_id, record_type, target_uri, payload_bytes, payload_digest, refers_to, payload of every record.

    archives: (name, bytes) below root.  payload_bytes and payload_digest are those of the whole payload also for a
    revisit, whose payload is null.  The digest of a response is computed anew from the payload that was read.
    """
    splits = archives.select("name", F.col("bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, F.col("size")))
    # As many tasks as splits: their rows are tiny, so adaptive coalescing would put all of them into one task.
    return splits.repartition(max(1, rows_of(splits)), F.col("name"), F.col("start")).mapInArrow(_read(root), RECORD_DDL)


def read_all(spark: SparkSession, root: str, archives: DataFrame, scratch: Scratch, *, split_bytes: int = SPLIT) -> DataFrame:
    """The records of read_warc, saved and counted: fails unless they are as many as archives (name, bytes, records) say."""
    got = scratch.save(read_warc(spark, root, archives, split_bytes=split_bytes), "records")
    n, want = rows_of(got), archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    if n != want:
        raise RuntimeError(f"{n} records were read under {root}, {want} were written")
    return got


def warc_round_trip(pages: DataFrame, *, min_bytes: int = 0, split_bytes: int = SPLIT) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back (see write_warc and read_all).

    An empty table writes no archive and gives no rows; rows that repeat an id are records of their own; columns other
    than page_id, url and html are not read.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    root = scratch.path("warc")
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    return read_all(spark, root, write_warc(pages, root, scratch, min_bytes=min_bytes), scratch, split_bytes=split_bytes)
