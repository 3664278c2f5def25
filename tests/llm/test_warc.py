import gzip
import hashlib

import pytest

from tessera.llm import warc
from tessera.llm.common import new_path

BIG = "é" * 600


def brute(rows, least=1000):
    data = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    out = []
    for i, b in data:
        same = [j for j, c in data if c == b and j is not None]
        lead = max(same, default=None)
        revisit = len(b) >= least and sum(c == b for _, c in data) > 1 and lead is not None and i != lead
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", BIG, "x"), (2, None, BIG, "x"), (7, "http://a/\r\nX: y", BIG, "x"), (7, "u", BIG, "x"), (None, "n", BIG, "x"), (3, "u", "small", "x"), (4, "u", "small", "x"), (5, "u", None, "x"), (6, "u", "", "x"), (8, "u", "\r\n\r\n" + "z" * 200_000, "x"), (None, "m", "q" * 1000, "x"), (None, "m", "q" * 1000, "x")]


def test_round_trip(spark):
    folder = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string"), folder)
    got = [tuple(r) for r in warc.page_records(spark, folder).collect()]
    assert sorted(got, key=str) == brute(ROWS)
    payload = {r.page_id: bytes(r.payload) for r in warc.read_warc(spark, folder).where("record_type = 'response' and page_id in (3, 5, 8)").collect()}
    assert payload == {3: b"small", 5: b"", 8: ROWS[9][2].encode()}


def test_pushdown_and_pruning(spark):
    folder = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(ROWS, "page_id long, url string, html string, x string"), folder)
    df = warc.read_warc(spark, folder, ["record_type", "page_id"]).where("record_type = 'revisit' and page_id < 2 and page_id is not null")
    assert [tuple(r) for r in df.collect()] == [("revisit", 1)]
    reader = warc.WarcReader(folder, ["page_id"])
    from pyspark.sql import datasource as ds

    kept = [ds.StringContains(("target_uri",), "a"), ds.EqualTo(("payload",), b"")]
    assert list(reader.pushFilters([ds.EqualTo(("record_type",), "revisit"), *kept])) == kept
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["page_id"] or 0 for r in rows) == [0, 1, 2]


def test_plain_gzip_members():
    rows = [dict(record_type="response", page_id=i, target_uri="u", payload=b"p" * (i * 3000), payload_length=i * 3000, payload_digest=hashlib.sha1(b"p" * (i * 3000)).hexdigest()) for i in range(3)]
    plain = b"".join(gzip.compress(warc.record_bytes(r)) for r in rows)
    ours = b"".join(warc._member(warc.record_bytes(r)) for r in rows)
    assert gzip.decompress(ours) == gzip.decompress(plain)
    for data in (plain, ours):
        assert [r.block().partition(b"\r\n\r\n")[2] for r in warc.records(data)] == [r["payload"] for r in rows]
    with pytest.raises(ValueError):
        list(warc.records(ours[:-400]))[-1].block()


def test_empty(spark):
    folder = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.page_records(spark, folder).collect() == []
