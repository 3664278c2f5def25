"""WARC archives as a PySpark data source.

``spark.dataSource.register(WarcSource)`` gives ``format("warc")`` for reading and writing. A record is one gzip member whose
extra field says how long the member is, so a reader parses the headers and steps over a payload it does not want without
inflating it (members without that field are inflated to find their end). Predicates on header columns are pushed down and
tested before the payload; a schema without ``payload`` never decodes one.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import new_path, read, staged

SCHEMA = "record_type string, record_id string, target_uri string, date string, page_id long, refers_to long, payload_digest string, payload_length long, payload binary"
ARROW = {"record_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "date": pa.string(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_length": pa.int64(), "payload": pa.binary()}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # records made from a table have no time of capture
ROLL = 64 << 20  # bytes of one archive, so that no reader's partition grows
SPLIT = 32 << 20  # bytes of files that a partition starts to collect
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000
EXTRA = b"SL"


def _member(data: bytes) -> bytes:
    """A gzip member with its own length (compressed, plain) in the extra field."""
    deflate = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 12 + 12 + len(body) + 8
    extra = EXTRA + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    if size >> 32:  # cannot be told: such a member is inflated to find its end
        extra = b"XX" + struct.pack("<HII", 8, 0, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record_bytes(row: dict) -> bytes:
    """One record; line ends in a URI are percent-encoded, since a header line cannot hold them."""
    payload, revisit = row.get("payload") or b"", row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row.get('record_id') or record_id(row.get('page_id'))}", f"WARC-Date: {row.get('date') or DATE}"]
    if row.get("target_uri") is not None:
        head.append("WARC-Target-URI: " + row["target_uri"].replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}")
    if row.get("page_id") is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(row['refers_to'])}", f"X-Refers-To-Page: {row['refers_to']}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if v}


class _Record:
    """A record of which only as much is inflated as was asked for."""

    def __init__(self, data, at: int):
        self.data, self.at = data, at
        if bytes(data[at : at + 3]) != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {at}")
        flags, skip, self.size = data[at + 3], 10, 0
        if flags & 4:
            n = struct.unpack_from("<H", data, at + 10)[0]
            if bytes(data[at + 12 : at + 14]) == EXTRA:
                self.size = struct.unpack_from("<I", data, at + 16)[0]
            skip = 12 + n
        for bit in (8, 16):  # a name, a comment
            if flags & bit:
                skip = bytes(data[at : at + skip + 65536]).index(b"\0", skip) + 1
        self.start = at + skip + (2 if flags & 2 else 0)
        self.inflate, self.fed = zlib.decompressobj(-15), self.start
        self.plain = b""
        self._until(lambda: b"\r\n\r\n" in self.plain)
        head, _, self.plain = self.plain.partition(b"\r\n\r\n")
        self.headers = _headers(head)

    def _until(self, enough) -> None:
        while not enough() and not self.inflate.eof:
            step = bytes(self.data[self.fed : self.fed + 2048]) if not self.inflate.unconsumed_tail else self.inflate.unconsumed_tail
            if not self.inflate.unconsumed_tail:
                self.fed += len(step)
            if not step:
                raise ValueError(f"the member at byte {self.at} is cut off")
            self.plain += self.inflate.decompress(step, 2048)

    def _rest(self) -> None:
        if not self.inflate.eof:
            end = self.at + self.size if self.size else len(self.data)
            more = [self.plain, self.inflate.decompress(self.inflate.unconsumed_tail + bytes(self.data[self.fed : end]))]
            self.plain, self.fed = b"".join(more), end
            if not self.inflate.eof:
                raise ValueError(f"the member at byte {self.at} is cut off")

    def block(self) -> bytes:
        self._rest()
        return self.plain[: int(self.headers["content-length"])]

    def next(self) -> int:
        if self.size:
            return self.at + self.size
        self._rest()
        return self.fed - len(self.inflate.unused_data) + 8


def records(data) -> Iterator[_Record]:
    at = 0
    while at < len(data):
        r = _Record(data, at)
        yield r
        at = r.next()


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _row(r: _Record, want_payload: bool) -> dict:
    h = r.headers
    digest = h.get("warc-payload-digest", "")
    digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    return {"record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "page_id": _number(h.get("x-page-id")), "refers_to": _number(h.get("x-refers-to-page")), "payload_digest": digest}


def _passes(row: dict, tests: list[tuple[str, str, object]]) -> bool:
    for op, column, value in tests:
        x = row[column]
        if op == "null":
            ok = x is None
        elif x is None:
            ok = False
        else:
            ok = {"=": lambda: x == value, "in": lambda: x in value, ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value, "starts": lambda: x.startswith(value), "set": lambda: True}[op]()
        if not ok:
            return False
    return True


HEADER_COLUMNS = {"record_type", "record_id", "target_uri", "date", "page_id", "refers_to", "payload_digest"}
KINDS = {ds.EqualTo: "=", ds.In: "in", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<=", ds.StringStartsWith: "starts"}


@dataclass
class _Files(ds.InputPartition):
    paths: list[str]


class WarcReader(ds.DataSourceReader):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names, self.tests = folder, names, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADER_COLUMNS:
                yield f
            elif type(f) in KINDS:
                self.tests.append((KINDS[type(f)], column, f.value))
            elif isinstance(f, (ds.IsNull, ds.IsNotNull)):
                self.tests.append(("null" if isinstance(f, ds.IsNull) else "set", column, None))
            else:
                yield f

    def partitions(self):
        system, path = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        files = sorted((f.size, f.path) for f in found if f.is_file and f.path.endswith(".warc.gz") and not f.base_name.startswith("."))
        out, held, size = [], [], 0
        for n, p in files[::-1]:
            if held and size + n > SPLIT:
                out.append(_Files(held))
                held, size = [], 0
            held.append(p)
            size += n
        return out + [_Files(held)] if held else out or [_Files([])]

    def read(self, partition):
        want = "payload" in self.names
        system, _ = fs.FileSystem.from_uri(self.folder)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as f:
                data = memoryview(f.read_buffer())
            for r in records(data):
                row = _row(r, want)
                if not _passes(row, self.tests):
                    continue
                if want or "payload_length" in self.names:
                    http = self._http(r)
                    row["payload_length"] = int(http.get("content-length", -1))
                    row["payload"] = r.block().partition(b"\r\n\r\n")[2] if want and row["record_type"] == "response" else None
                    size += len(row["payload"] or b"")
                rows.append(row)
                if size > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _http(r: _Record) -> dict[str, str]:
        r._until(lambda: b"\r\n\r\n" in r.plain)
        return _headers(r.plain.partition(b"\r\n\r\n")[0])

    def _batch(self, rows):
        return pa.record_batch([pa.array([r.get(n) for r in rows], ARROW[n]) for n in self.names], self.names)


@dataclass
class _Written(ds.WriterCommitMessage):
    moves: list[tuple[str, str]]


class WarcWriter(ds.DataSourceArrowWriter):
    """Each task writes hidden files; the commit on the driver gives them their names, so a retried or lost task leaves nothing."""

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator):
        system, path = fs.FileSystem.from_uri(self.folder)
        system.create_dir(path, recursive=True)
        moves, out, size = [], None, 0
        task = TaskContext.get()
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{len(moves):04d}-{uuid.uuid4().hex[:8]}.warc.gz"
                    moves.append((f"{path}/.{name}", f"{path}/{name}"))
                    out, size = system.open_output_stream(moves[-1][0], compression=None), 0
                member = _member(record_bytes(row))
                out.write(member)
                size += len(member)
                if size >= ROLL:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(moves)

    def commit(self, messages):
        system, path = fs.FileSystem.from_uri(self.folder)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if f.is_file and f.path.endswith(".warc.gz") and not f.base_name.startswith("."):
                    system.delete_file(f.path)
        for m in messages:
            for held, final in m.moves if m else ():
                system.move(held, final)

    def abort(self, messages):
        system, _ = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            for held, _ in m.moves if m else ():
                system.delete_file(held)


class WarcSource(ds.DataSource):
    """``load(folder)`` gives one row per record; ``save(folder)`` takes the columns of SCHEMA (those it has)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return WarcReader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool):
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    register(spark)
    kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
    return spark.read.format("warc").schema(", ".join(f"{c} {kinds[c]}" for c in columns or kinds)).load(folder)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> None:
    """One record per row. Of equal payloads of at least ``least`` bytes the row with the largest id is the response, the rest revisit it.

    Null html is an empty payload, a null url gives no URI. Null ids are the smallest; rows that repeat the largest id are all
    responses, as are all of a group that has no id. Other columns are ignored.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    base = base.withColumns({"payload_length": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    # only digests are gathered; of them, only those that occur again
    again = base.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = staged(again, "digests")
    joined = base.join(again, "payload_digest", "left")
    revisit = F.coalesce(F.col("lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead")) & (F.col("payload_length") >= least), F.lit(False))
    rows = joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "page_id",
        F.when(revisit, F.col("lead")).alias("refers_to"),
        "payload_digest",
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    rows.write.format("warc").mode("append").save(folder)


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of an archive; a response's digest is that of the bytes read."""
    got = read_warc(spark, folder, ["record_type", "page_id", "refers_to", "payload_digest", "payload_length", "payload"])
    response = F.col("record_type") == "response"
    return got.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), folder)
    return page_records(spark, folder)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
g AS (SELECT h, max(page_id) AS lead FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN g.lead <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.lead <> d.page_id THEN g.lead END AS refers_to
FROM d LEFT JOIN g ON g.h = d.h AND d.n >= 1000
"""
