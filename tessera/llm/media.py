"""Media columns over a store of content-defined chunks.

A payload is kept losslessly as 8-bit PCM samples in a WAV container. Its samples are cut where a rolling gear hash says so, so
that equal passages become equal chunks wherever they stand. Chunks are known by digest; Spark joins find those that occur more
than once. Such a chunk is stored once, in the table of shared chunks; a text's other chunks are stored with its ordered chunk
list. Reading puts the media together again from the list and checks every chunk's digest.

The media themselves are shuffled only where they have shared chunks. The list of those, which is small, goes to the place where
the media are read: it is written by input file, and the task that reads a file takes that file's part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read, sliced, staged, text_key

RATE, UNIT = 8000, 64
LEAST, MEAN_BITS, MOST = 256, 11, 16384  # bytes of a chunk: at least, 2**bits more on average, at most
WINDOW = 32  # bytes that a 32-bit gear hash depends on
GEAR = np.random.default_rng(9).integers(0, 2**32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> bytes:
    """The text's UTF-8 bytes, filled with zeros to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes((-len(data)) % UNIT if data else UNIT)


def wav_head(n: int, rate: int = RATE) -> bytes:
    """The 44 bytes before n 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", (36 + n) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", n)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: the sum of the last WINDOW bytes' gears, each shifted by its distance; built by doubling."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h, width = wider, width * 2
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    found = np.flatnonzero(gear(np.frombuffer(data, np.uint8)) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    out, at, n = [], 0, len(data)
    while n - at > LEAST:
        k = int(np.searchsorted(found, at + LEAST))
        at = min(int(found[k]) if k < len(found) else n, at + MOST, n)
        out.append(at)
    if at < n:
        out.append(n)
    return out


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


LISTS = "pack long, key binary, seq int, digest binary"


def _list_chunks(batches):
    for batch in sliced(batches):
        pack, key, seq, dig = [], [], [], []
        for p, k, text in zip(*batch.to_pydict().values()):
            part = [digest(c) for c in chunks(payload_of(text))]
            pack += [p] * len(part)
            key += [k] * len(part)
            seq += range(len(part))
            dig += part
        yield pa.record_batch([pa.array(pack, pa.int64()), pa.array(key, pa.binary()), pa.array(seq, pa.int32()), pa.array(dig, pa.binary())], ["pack", "key", "seq", "digest"])


STORE = "key binary, kind int, head binary, digests array<binary>, shared array<int>, data binary"
STORED = pa.schema([("key", pa.binary()), ("kind", pa.int32()), ("head", pa.binary()), ("digests", pa.list_(pa.binary())), ("shared", pa.list_(pa.int32())), ("data", pa.binary())])
MEDIA, CHUNK = 0, 1


def _plan_of(folder: str, pack: int) -> dict[bytes, tuple[bool, dict[int, bool]]]:
    """For the texts of one file that have something shared: (stored here, {chunk: stored here})."""
    system, path = fs.FileSystem.from_uri(f"{folder}/pack={pack}")
    out: dict = {}
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    for f in found:
        if f.path.endswith(".parquet"):
            with system.open_input_file(f.path) as source:
                for row in pq.ParquetFile(source).read().to_pylist():
                    out[row["key"]] = (row["here"], {s["seq"]: s["here"] for s in row["shared"] or ()}, row["again"])
    return out


def _store(folder: str):
    def run(batches):
        held, plan, seen = None, {}, set()
        pack_up = zstandard.ZstdCompressor(level=6).compress
        for batch in sliced(batches):
            rows = []
            for pack, key, text in zip(*batch.to_pydict().values()):
                if pack != held:
                    held, plan, seen = pack, _plan_of(folder, pack), set()
                here, shared, again = plan.get(key, (True, {}, False))
                if not here or key in seen:
                    continue
                if again:
                    seen.add(key)
                data = payload_of(text)
                parts = chunks(data)
                digests = [digest(c) for c in parts]
                own = b"".join(c for i, c in enumerate(parts) if i not in shared)
                rows.append((key, MEDIA, wav_head(len(data)), digests, sorted(shared), pack_up(struct.pack(f"<{len(parts)}I", *map(len, parts)) + own)))
                rows += [(digests[i], CHUNK, None, None, None, pack_up(parts[i])) for i, write in shared.items() if write]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), STORED.types)], schema=STORED)

    return run


def write_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Writes the media of all distinct texts; returns the store.

    Null texts count as empty. The documents are read twice, so they must be files: what has none is written first.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(text_col).cast("string").alias("text"))
    if not base.inputFiles() or "Scan" not in base._jdf.queryExecution().executedPlan().toString() or "Exchange" in base._jdf.queryExecution().executedPlan().toString():
        base = staged(base, "media-input")
    base = base.select(F.xxhash64(F.input_file_name()).alias("pack"), text_key("text").alias("key"), "text")
    lists = staged(base.mapInArrow(_list_chunks, LISTS), "chunk-lists")
    # one entry for each chunk of a text, however often the text occurs; the first file that has a text stores it
    once = lists.groupBy("key", "seq", "digest").agg(F.min("pack").alias("pack"), F.count("*").alias("copies"))
    once = staged(once, "chunk-places")
    shared = once.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "seq")).alias("owner")).where("n > 1")
    place = F.struct("seq", (F.struct("key", "seq") == F.col("owner")).alias("here"))
    of_key = once.join(shared, "digest").groupBy("key").agg(F.collect_list(place).alias("shared"))
    again = once.where("seq = 0 and copies > 1").select("key", F.lit(True).alias("again"))
    special = of_key.join(again, "key", "full").select("key", "shared", F.coalesce("again", F.lit(False)).alias("again"))
    packs = lists.where("seq = 0").select("pack", "key").distinct().join(once.where("seq = 0").select("key", F.col("pack").alias("first")), "key")
    plan = packs.join(special, "key").select("pack", "key", (F.col("pack") == F.col("first")).alias("here"), "shared", "again")
    folder = new_path(spark, "chunk-plan")
    plan.repartition("pack").write.partitionBy("pack").parquet(folder)
    return staged(base.mapInArrow(_store(folder), STORE), "media-store")


class _Features:
    """Features of a payload that comes in parts, and its digests."""

    def __init__(self, head: bytes):
        self.payload, self.media = hashlib.sha256(), hashlib.sha256(head)
        self.head, self.n, self.total, self.square, self.crossings, self.peak, self.last, self.tail = len(head), 0, 0, 0, 0, 0, None, b""

    def add(self, part: bytes) -> None:
        if not part:
            return
        self.payload.update(part)
        self.media.update(part)
        x = np.frombuffer(part, np.uint8).astype(np.int64) - 128
        self.n += len(x)
        self.total += int(x.sum())
        self.square += int((x * x).sum())
        self.peak = max(self.peak, int(np.abs(x).max()))
        up = x >= 0
        self.crossings += int((up[1:] != up[:-1]).sum()) + int(self.last is not None and bool(up[0]) != self.last)
        self.last = bool(up[-1])
        self.tail = (self.tail + part[-UNIT:])[-UNIT:]

    def row(self, key: bytes) -> tuple:
        text = f"mean={self.total / self.n:.6f};rms={(self.square / self.n) ** 0.5:.6f};peak={self.peak};crossings={self.crossings}"
        return key, self.n, self.payload.hexdigest(), zlib.crc32(self.tail), self.n + self.head, self.media.hexdigest(), text


FEATURES = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
FEATURED = pa.schema([("key", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_parts(head: bytes, digests: list[bytes], shared: list[int], data: bytes, fetch):
    """The media's bytes in order: its head, then each chunk, own ones from ``data``, shared ones from ``fetch(place)``; all are checked."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = struct.unpack_from(f"<{len(digests)}I", raw)
    at, others = 4 * len(digests), set(shared)
    yield head
    for i, (want, size) in enumerate(zip(digests, sizes)):
        if i in others:
            part = fetch(i)
        else:
            part = raw[at : at + size]
            at += size
        if digest(part) != want:
            raise ValueError("a stored chunk differs from its digest")
        yield part


def _features(head, digests, shared, data, fetch, key):
    parts = media_parts(head, digests, shared, data, fetch)
    out = _Features(next(parts))
    block: list[bytes] = []
    held = 0
    for part in parts:  # some chunks at a time
        block.append(part)
        held += len(part)
        if held > 1 << 20:
            out.add(b"".join(block))
            block, held = [], 0
    out.add(b"".join(block))
    return out.row(key)


def _whole(batches):
    for batch in sliced(batches):
        rows = [_features(head, digests, (), data, None, key) for key, head, digests, data in zip(*batch.to_pydict().values())]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), FEATURED.types)], schema=FEATURED)


def _joined(batches):
    """Rows (key, seq, head, digests, shared, data) sorted by key and seq: a media row (seq -1), then its shared chunks in order."""
    unpack = zstandard.ZstdDecompressor().decompress
    rows = (r for batch in sliced(batches) for r in zip(*batch.to_pydict().values()))
    media, found = None, {}

    def done():
        key, _, head, digests, shared, data = media
        row = _features(head, digests, shared, data, lambda i: unpack(found[i]), key)
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, FEATURED.types)], schema=FEATURED)

    for r in rows:
        if r[1] == -1:
            if media is not None and media[0] != r[0]:
                yield done()
                found = {}
            media = r
        else:
            found[r[1]] = r[5]
    if media is not None:
        yield done()


def read_features(store: DataFrame) -> DataFrame:
    """One row per stored text, from its media as read back."""
    media = store.where(F.col("kind") == MEDIA)
    whole = media.where(F.size("shared") == 0).select("key", "head", "digests", "data").mapInArrow(_whole, FEATURES)
    part = media.where(F.size("shared") > 0)
    wanted = part.select("key", "digests", F.explode("shared").alias("seq")).select("key", "seq", F.col("digests")[F.col("seq")].alias("digest"))
    chunk = store.where(F.col("kind") == CHUNK).select(F.col("key").alias("digest"), "data").dropDuplicates(["digest"])
    none = [F.lit(None).cast(t).alias(n) for n, t in (("head", "binary"), ("digests", "array<binary>"), ("shared", "array<int>"))]
    fetched = wanted.join(chunk, "digest", "left").select("key", "seq", *none, "data")
    rows = part.select("key", F.lit(-1).alias("seq"), "head", "digests", "shared", "data").unionByName(fetched)
    joined = rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(_joined, FEATURES)
    return whole.unionByName(joined).dropDuplicates(["key"])


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the digests and features of its stored media; equal texts get equal values.

    A null text counts as empty: its payload is UNIT zero bytes. Ids are only carried along, so nulls and repeats among them are
    kept. An empty table gives no rows.
    """
    features = staged(read_features(write_store(docs, text_col)), "media-features")
    base = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("key"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    return base.join(features, "key").drop("key").withColumnRenamed("_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read(spark, sf_dir, "documents"))
