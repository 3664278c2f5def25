"""Token ids in wavelet-matrix shards.

A shard is one file: the documents' ids and lengths, and for each bit of the token ids, highest first, the bit plane of the
sequence as the planes above have ordered it, compressed by zstd, with its number of zeros and the ones of each BLOCK bits.
Access, rank (count) and select (occurrence lookup) need only the planes and the block sums.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, read, staged
from .files import read_file, write_file

MAGIC = b"WVMX0001"
BLOCK = 512
STEP = 1 << 15  # bits of a plane parted at once, few enough for a core's cache
SHARD_TOKENS = 4_000_000
END_ID = 1
READERS = 4096  # tasks at most that read shards, one shard or more each


def _parts(one: np.ndarray, zeros: int):
    """For each STEP bits of a plane: their start, the places of ones and zeros in them, and where the plane's parting puts the first zero and the first one."""
    a, b = 0, zeros
    for at in range(0, len(one), STEP):
        bits = one[at : at + STEP]
        ones, rest = np.flatnonzero(bits), np.flatnonzero(~bits)
        yield at, ones, rest, a, b
        a, b = a + len(rest), b + len(ones)


def _planes(ids: np.ndarray, bits: int):
    """(packed bits, zeros) from the highest bit down; each plane leaves the sequence parted, zeros first."""
    ids, parted = ids.copy(), np.empty_like(ids)
    for b in range(bits - 1, -1, -1):
        one = (ids & ids.dtype.type(1 << b)) != 0
        zeros = len(ids) - int(np.count_nonzero(one))
        yield np.packbits(one, bitorder="little"), zeros
        for at, ones, rest, a, b in _parts(one, zeros):
            part = ids[at : at + STEP]
            parted[a : a + len(rest)], parted[b : b + len(ones)] = part[rest], part[ones]
        ids, parted = parted, ids


class WaveletMatrix:
    """Rank and select over a sequence of token ids."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], blocks: list[np.ndarray]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.ones = [np.concatenate(([0], np.cumsum(b, dtype=np.int64))) for b in blocks]

    @classmethod
    def of(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        ids = np.asarray(ids)
        bits = bits or max(1, int(ids.max(initial=0)).bit_length())
        ids = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        made = list(_planes(ids, bits))
        return cls(len(ids), [p for p, _ in made], [z for _, z in made], [cls._sums(p) for p, _ in made])

    @staticmethod
    def _sums(plane: np.ndarray) -> np.ndarray:
        size = BLOCK // 8
        padded = np.concatenate((plane, np.zeros(-len(plane) % size, np.uint8)))
        return np.bitwise_count(padded.view(np.uint64)).reshape(-1, size // 8).sum(axis=1).astype(np.uint16)

    def to_bytes(self) -> bytes:
        out = [struct.pack("<QI", self.n, len(self.planes))]
        pack = zstandard.ZstdCompressor(level=1).compress
        for plane, zeros, ones in zip(self.planes, self.zeros, self.ones):
            bits, sums = pack(plane.tobytes()), pack(np.diff(ones).astype(np.uint16).tobytes())
            out += [struct.pack("<QQQ", zeros, len(bits), len(sums)), bits, sums]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        n, bits = struct.unpack_from("<QI", data)
        at, planes, zeros, blocks = 12, [], [], []
        unpack = zstandard.ZstdDecompressor().decompress
        for _ in range(bits):
            z, a, b = struct.unpack_from("<QQQ", data, at)
            at += 24
            planes.append(np.frombuffer(unpack(data[at : at + a]), np.uint8))
            blocks.append(np.frombuffer(unpack(data[at + a : at + a + b]), np.uint16))
            zeros.append(z)
            at += a + b
        return cls(n, planes, zeros, blocks)

    def _bit(self, level: int, i: np.ndarray) -> np.ndarray:
        return (self.planes[level][i >> 3] >> (i & 7).astype(np.uint8)) & 1

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        plane, block = self.planes[level], i // BLOCK
        bytes_ = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
        inside = np.where(bytes_ < len(plane), plane[np.minimum(bytes_, max(len(plane) - 1, 0))] if len(plane) else 0, 0).astype(np.uint8)
        bits = np.unpackbits(inside, axis=1, bitorder="little")
        bits[np.arange(BLOCK) >= (i % BLOCK)[:, None]] = 0
        return self.ones[level][np.minimum(block, len(self.ones[level]) - 1)] + bits.sum(axis=1, dtype=np.int64)

    def access(self, positions) -> np.ndarray:
        i = np.atleast_1d(np.asarray(positions, np.int64)).copy()
        out = np.zeros(len(i), np.uint32)
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            out = (out << np.uint32(1)) | bit
            i = np.where(bit == 1, zeros + ones, i - ones)
        return out

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        if symbol >> len(self.planes):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            a, b = (int(x) for x in self._rank1(level, np.array([lo, hi], np.int64)))
            lo, hi = (zeros + a, zeros + b) if symbol >> (len(self.planes) - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, symbol: int, end: int | None = None) -> int:
        """Occurrences of the symbol before ``end``."""
        lo, hi = self._range(symbol, self.n if end is None else end)
        return hi - lo

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence, from 0; IndexError beyond the last."""
        lo, hi = self._range(symbol, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one = symbol >> (len(self.planes) - 1 - level) & 1
            i = self._select_bit(level, one, i - self.zeros[level] if one else i)
        return i

    def _select_bit(self, level: int, one: int, k: int) -> int:
        ones = self.ones[level]
        before = ones if one else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8]
        bits = np.unpackbits(part, bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def all(self) -> np.ndarray:
        """The whole sequence: planes are undone from the last."""
        ids = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z, back = self.zeros[level], np.empty_like(ids)
            ids[z:] |= ids.dtype.type(1 << (len(self.planes) - 1 - level))
            for at, ones, rest, a, b in _parts(one, z):
                part = back[at : at + STEP]
                part[rest], part[ones] = ids[a : a + len(rest)], ids[b : b + len(ones)]
            ids = back
        return ids


def shard_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int) -> list[bytes]:
    """A shard file: the documents' ids (a flag for null ones) and lengths, then the wavelet matrix."""
    null = np.array([i is None for i in doc_ids], np.uint8)
    known = np.array([i or 0 for i in doc_ids], "<i8")
    head = zstandard.ZstdCompressor(level=1).compress(known.tobytes() + lengths.astype("<i8").tobytes() + null.tobytes())
    return [MAGIC, struct.pack("<QQ", len(doc_ids), len(head)), head, WaveletMatrix.of(ids, bits).to_bytes()]


def open_shard(data: bytes) -> tuple[np.ma.MaskedArray, np.ndarray, WaveletMatrix]:
    """(document ids, null ones masked; lengths; tokens) of a shard file."""
    if data[:8] != MAGIC:
        raise ValueError("not a wavelet shard")
    n, size = struct.unpack_from("<QQ", data, 8)
    head = zstandard.ZstdDecompressor().decompress(data[24 : 24 + size])
    numbers, null = np.frombuffer(head, "<i8", 2 * n), np.frombuffer(head, bool, n, 16 * n)
    return np.ma.array(numbers[:n], mask=null), numbers[n:], WaveletMatrix.from_bytes(data[24 + size :])


#: Letters that are one letter in NFC, alone and as small letters, and that no letter beside them changes.
LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u045f\u05d0-\u05ea\u0621-\u064a\u0904-\u0939\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_TIGHT = f"[^{LETTERS}0-9 \t\n\r][.,] "
_MARK = "[\u0300-\u036f]"
#: The pipeline before the merges for which texts may be cut into runs.
SPLITTABLE = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def splittable(spec: dict) -> bool:
    """Whether a tokenizer file normalizes and splits such that no token reaches over white space, or from a letter or digit to a stop or comma."""
    before = spec.get("pre_tokenizer") or {}
    parts = before.get("pretokenizers") or [{}, {}]
    known = [spec.get("normalizer"), (parts[0].get("pattern") or {}).get("Regex"), parts[-1]] == SPLITTABLE and len(parts) == 2
    whole = parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True and spec.get("truncation") is None and spec.get("padding") is None
    added = all("<|" in t["content"] and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens", []))
    return known and whole and added


class Encoder:
    """The library's ids of whole texts.

    Where the tokenizer is ``splittable`` they come from its ids of the runs between spaces and line ends: no pattern or merge reaches
    over white space, so the ids of a text are those of its runs in order; nor does one reach from a letter of LETTERS or a digit to a
    full stop or comma that ends a run. Runs repeat, and each is encoded once while it is remembered: the runs met since ``remembered``
    new ones were, and as many before them. ASCII capitals are made small first, so that fewer runs differ, but not in texts that could
    hold a special token or have combining marks, which a small letter may join where the capital does not.
    Any other tokenizer encodes each text as a whole.
    """

    def __init__(self, path: str, remembered: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.before, self.remembered = Tokenizer.from_file(path), {}, {}, remembered
        with open(path, encoding="utf-8") as f:
            self.runs = splittable(json.load(f))
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")

    @staticmethod
    def _runs(texts: pa.LargeStringArray) -> pa.LargeListArray:
        special = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, _MARK))
        texts = pc.replace_substring(pc.if_else(special, texts, pc.ascii_lower(texts)), "\n", " ")
        tight = pc.match_substring_regex(texts, _TIGHT)  # elsewhere every stop or comma before a space follows a space, a letter or a digit
        apart = pc.replace_substring(pc.replace_substring(texts, ". ", " . "), ", ", " , ")
        return pc.split_pattern(pc.if_else(tight, texts, apart), " ")

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(got.ids, self.kind).tobytes() for got in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, runs: set[str]) -> None:
        known, before = self.known, self.before
        old = {r: before[r] for r in runs if r in before} if before else {}
        known.update(old)
        new, size = [*runs.difference(old)], self.kind.itemsize
        # many runs are encoded as one text, since cutting a text at spaces is what gave them; each token belongs to the run in which it begins
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.cumsum([0, *(len(r) + 1 for r in part)])
            cut = (np.searchsorted(np.fromiter((a for a, _ in got.offsets), np.int64, len(got)), begins) * size).tolist()
            ids = np.array(got.ids, self.kind).tobytes()
            known.update(zip(part, map(ids.__getitem__, map(slice, cut, cut[1:]))))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.runs:
            return self._whole([t or "" for t in texts])
        if len(self.known) > self.remembered:
            self.known, self.before = {}, self.known
        runs = self._runs(pa.array([t or "" for t in texts], pa.large_string()))
        codes = runs.values.dictionary_encode()  # each distinct run is looked up once, all else is array work
        distinct = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [*map(self.known.get, distinct)]
        new = [i for i, x in enumerate(found) if x is None]
        self._learn({distinct[i] for i in new})
        for i in new:
            found[i] = self.known[distinct[i]]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        codes = codes.indices.to_numpy()
        counts = sizes[codes]
        ends = np.concatenate(([0], np.cumsum(counts)))
        # the place of each id among those of the distinct runs: where its run's begin, and how far into the run it is
        places = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], counts)
        places += np.arange(len(places))
        ids = np.frombuffer(b"".join(found), self.kind)[places].tobytes()
        cut = (ends[runs.offsets.to_numpy()] * self.kind.itemsize).tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:])]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECE_BYTES = 4_000_000


def _pieces(batch: pa.RecordBatch, size: int = PIECE_BYTES):
    """The batch's rows in order, cut where a piece's texts reach ``size`` bytes: so much is encoded at once, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)) + 1
        yield batch.slice(at, end - at)
        at = end


MANIFEST = "part int, seq int, path string, docs long, tokens long"


def _write(folder: str, path: str, shard_tokens: int):
    def run(batches):
        encode, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([END_ID], encode.kind).tobytes()
        ids, held, count = [], [], 0

        def shard():
            lengths = np.array([len(x) // encode.kind.itemsize for x in held], np.int64)
            data = shard_bytes(ids, lengths, np.frombuffer(b"".join(held), encode.kind), encode.bits)
            at = write_file(folder, f"shard-{part:06d}-{seq:06d}.wvm", data)
            return pa.record_batch([pa.array([x], k) for x, k in zip((part, seq, at, len(ids), int(lengths.sum())), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "path", "docs", "tokens"])

        for batch in batches:
            for piece in _pieces(batch):
                for i, tokens in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist())):
                    ids.append(i)
                    held.append(tokens + end)
                    count += len(held[-1]) // encode.kind.itemsize
                    if count >= shard_tokens:
                        yield shard()
                        ids, held, count, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    return run


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes all texts' ids, each text's followed by END_ID, in ascending order of ids (nulls first, ties by text); returns the manifest.

    Null texts count as empty. Every shard of a partition is cut at ``shard_tokens``, so hot ranges and long texts make more
    shards, not larger ones. An empty table gives an empty manifest.
    """
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # ranges of ids from a scan of the ids alone, so that no text is read twice
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(base.where("id is not null").approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("id"))), F.lit(0)) if bounds else F.lit(0)
    parted = base.repartitionById(n, F.when(F.col("id").isNull(), 0).otherwise(part)).sortWithinPartitions("id", "text")
    return staged(parted.mapInArrow(_write(folder, tokenizer, shard_tokens), MANIFEST), "manifest")


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"


def _read(batches):
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            doc_ids, lengths, matrix = open_shard(read_file(path))
            raw = matrix.all().astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.record_batch([pa.array(doc_ids), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), pa.array([path] * len(crc), pa.string())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files of a manifest: where its ids start in the whole sequence, how many, their CRC-32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition that wrote
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    placed = manifest.join(parts, "part").select("path", (F.col("base") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).alias("start"))
    tasks = max(1, min(manifest.count(), READERS))
    return placed.repartition(tasks).mapInArrow(_read, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(read(spark, sf_dir, "documents"), new_path(spark, "wavelet")))
