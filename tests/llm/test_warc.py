import base64
import io
import random

import pyarrow as pa
import pytest

from tallyspark.llm.common import Scratch, table
from tallyspark.llm.queries import op10_warc_round_trip
from tallyspark.llm.warc import _Bytes, digest, read_all, read_warc, record, records, warc_round_trip, write_warc

SF01 = "/root/testdata/sf0.01"


def expected(rows, least=0):
    last: dict = {}
    for i, html in rows:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    out = []
    for i, html in rows:
        p = (html or "").encode()
        rev = len(p) >= least and (html or "") in last and last[html or ""] != i
        out.append((i, len(p), digest(p), "revisit" if rev else "response", last[html or ""] if rev else None))
    return sorted(out, key=repr)


def rows(got):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr)


@pytest.mark.parametrize("split", [37, 1000, 1 << 20])
def test_round_trip(spark, split):
    html = ["a", "", None, "é" * 500, "WARC/1.1\r\n\r\n", "x\r\n\r\ny", "".join(chr(48 + i * i % 80) for i in range(5000)), "a", "", "big" * 20000]
    data = [(i, h) for i, h in enumerate(html * 2)] + [(3, "a"), (3, "a"), (None, "a"), (None, "lone")]
    df = spark.createDataFrame([(i, "http://x/%25\r\n" if i == 1 else None if i == 2 else f"http://x/{i}", h, b"z", 1) for i, h in data], "page_id long, url string, html string, payload binary, Records int")
    got = warc_round_trip(df.repartition(3), split_bytes=split).collect()
    assert rows(got) == expected(data)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    assert {r.target_uri for r in got if r.page_id in (1, 2)} == {"http://x/%25\r\n", None}


def test_minimum_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", ""), (4, "u", None)], "page_id long, url string, html string")
    assert rows(warc_round_trip(df, min_bytes=3).collect()) == expected([(1, "abc"), (2, "abc"), (3, ""), (4, "")], 3)
    assert warc_round_trip(df.limit(0)).collect() == []


def test_candidates_that_are_no_records():
    """The magic inside other members, a plain gzip member and cut-off data are passed over."""
    import gzip
    a, b = record(1, "u", b"one", None, "d"), record(2, "u", b"two", None, "d")
    raw = b"\x1f\x8b\x08junk" + a + gzip.compress(b"no headers") + b"\x1f\x8b" + b + a[:40]
    got = [(h["warc-record-id"], p) for h, p in records(_Bytes(pa.PythonFile(io.BytesIO(raw), "r"), len(raw)), 0, len(raw))]
    assert got == [("<urn:page:1>", b"one"), ("<urn:page:2>", b"two")]
    whole = a + b
    for cut in range(1, len(whole)):
        got = [h["warc-record-id"] for lo, hi in ((0, cut), (cut, len(whole))) for h, _ in records(_Bytes(pa.PythonFile(io.BytesIO(whole), "r"), len(whole)), lo, hi)]
        assert got == ["<urn:page:1>", "<urn:page:2>"]


def test_query(spark):
    assert rows(op10_warc_round_trip(spark, SF01).collect()) == expected([(r.page_id, r.html) for r in table(spark, SF01, "pages").collect()])


def test_archives_are_gzip(spark):
    import gzip
    import urllib.parse
    import urllib.request
    scratch = Scratch(spark, "warc-test")
    root = "file://" + scratch.path("w").removeprefix("file://").removeprefix("file:")
    made = write_warc(table(spark, SF01, "pages"), root, scratch).collect()
    path = urllib.request.url2pathname(urllib.parse.urlparse(root).path)
    n = 0
    for r in made:
        with gzip.open(f"{path}/{r.name}") as f:
            n += f.read().count(b"WARC/1.1\r\n")
    assert n == sum(r.records for r in made) == read_warc(spark, root, spark.createDataFrame(made), split_bytes=10_000).count()


@pytest.mark.parametrize("split", [1000, 1 << 20])
def test_long_urls(spark, split):
    """Headers of 200 KB that hardly compress, alone, in a row, and with a payload."""
    url = "data:text/html;base64," + base64.b64encode(random.Random(3).randbytes(150_000)).decode()
    data = [(1, "http://x/1", "a"), (2, url + "2", "b" * 70_000), (3, url + "3", ""), (4, "http://x/4", "a"), (5, url + "5", "c")]
    got = warc_round_trip(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1), split_bytes=split).collect()
    assert rows(got) == expected([(i, h) for i, _, h in data])
    assert {r.page_id: r.target_uri for r in got} == {i: u for i, u, _ in data}


def test_missing_records_fail(spark):
    scratch = Scratch(spark, "warc-test")
    root = "file://" + scratch.path("w").removeprefix("file://").removeprefix("file:")
    made = write_warc(spark.createDataFrame([(1, "u", "abc"), (2, "u", "d")], "page_id long, url string, html string"), root, scratch)
    assert read_all(spark, root, made, scratch).count() == 2
    with pytest.raises(RuntimeError, match="written"):
        read_all(spark, root, made.selectExpr("name", "bytes", "records + 1 as records"), scratch)
