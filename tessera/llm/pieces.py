"""SentencePiece encoding and decoding, with a max-plus parallel scan over giant documents.

The pieces of a text are its one sequence of pieces in which each two neighbours are what the library makes of them together, so
encoding is a path through states at places of the text, and what is known of a chunk is a matrix over the states at its two
ends. A state at a boundary is the piece that crosses it or ends there. An entry of a chunk's matrix is the number of pieces
between two states, or minus infinity where the library would not encode the chunk that way. Matrices of neighbouring chunks
combine by the max-plus product, which is associative; the finite path gives the state at each boundary and where each chunk's
pieces start in the whole; then every chunk is encoded for itself between its two states.

Texts of up to CHUNK characters are one chunk, whose only path is the library's encoding.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, sliced, staged, text_key

CHUNK = 32_768
MARK = "▁"
NONE = -np.inf


class Pieces:
    """A SentencePiece BPE model, and the same without normalization for parts of normalized texts."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        n = proto.normalizer_spec
        self.plain = not n.precompiled_charsmap and not n.remove_extra_whitespaces and n.escape_whitespaces
        n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
        n.precompiled_charsmap = b""
        self.part = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.longest = max(map(len, self.normal))
        self.breaks = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.normal)  # no piece goes over the start of a word
        table = []
        for p in proto.pieces:
            byte = p.type == kinds.BYTE
            table.append(bytes([int(p.piece[3:5], 16)]) if byte else b"" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ").encode())
        self.bytes = table

    def normalize(self, text: str) -> str:
        """What the library encodes: spaces as marks, a mark before the text."""
        if not self.plain:
            return self.whole.normalize(text)
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.whole.encode(texts, num_threads=1)

    def encode_part(self, normalized: str) -> list[int]:
        return self.part.encode(normalized, num_threads=1)

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def crossing(self, before: str, after: str) -> list[tuple[int, int]]:
        """States at a boundary as (characters before it, after it): pieces that start before it and end at it or after it. One unknown character is a piece."""
        out = []
        for x in range(1, min(self.longest, len(before)) + 1):
            for y in range(0, min(self.longest - x, len(after)) + 1):
                if x + y == 1 or before[len(before) - x :] + after[:y] in self.normal:
                    out.append((x, y))
        return out

    def _is(self, ids: list[int], head: str, tail: str) -> int | None:
        """How many pieces follow the head, if the ids begin with the head's one piece and end with the tail's; '' asks nothing."""
        n = len(ids)
        if head:
            k = self._size(head)
            if ids[:k] != self._ids(head):
                return None
            n -= k
        if tail and ids[-self._size(tail) :] != self._ids(tail):
            return None
        return n

    def _ids(self, piece: str) -> list[int]:
        return [self.normal[piece]] if piece in self.normal else self.encode_part(piece)

    def _size(self, piece: str) -> int:
        return len(self._ids(piece))

    def matrix(self, before: str, body: str, after: str) -> np.ndarray:
        """Transfer matrix of a chunk: rows are the states at its start (one, if it starts the text), columns those at its end."""
        starts = self.crossing(before, body) if before else [(0, 0)]
        ends = self.crossing(body, after) if after else [(0, 0)]
        heads = [before[len(before) - x :] + body[:y] if x else "" for x, y in starts]
        tails = [body[len(body) - x :] + after[:y] if x else "" for x, y in ends]
        out = np.full((len(starts), len(ends)), NONE)
        first = body.find(MARK, self.longest + 1)
        while first > 0 and body[first - 1] == MARK:
            first = body.find(MARK, first + 1)
        last = body.rfind(MARK, 0, len(body) - self.longest)
        while last > 0 and body[last - 1] == MARK:
            last = body.rfind(MARK, 0, last)
        if self.breaks and 0 < first <= last:  # the chunk falls into three parts that do not touch each other
            left = [self._is(self.encode_part(h + body[y:first]), h, "") for h, (_, y) in zip(heads, starts)]
            middle = len(self.encode_part(body[first:last])) if first < last else 0
            right = [self._is(self.encode_part(body[last : len(body) - x] + t), "", t) for t, (x, _) in zip(tails, ends)]
            for i, p in enumerate(left):
                for k, q in enumerate(right):
                    if p is not None and q is not None:
                        out[i, k] = p + middle + q
            return out
        for i, (h, (_, y)) in enumerate(zip(heads, starts)):
            for k, (t, (x, _)) in enumerate(zip(tails, ends)):
                if y <= len(body) - x:
                    n = self._is(self.encode_part(h + body[y : len(body) - x] + t), h, t)
                    out[i, k] = NONE if n is None else n
        return out

    def between(self, before: str, body: str, after: str, start: int, end: int) -> list[int]:
        """The ids of a chunk between two of its states: those after the first state's piece, up to the second's."""
        x, y = (self.crossing(before, body) if before else [(0, 0)])[start]
        head = before[len(before) - x :] + body[:y] if x else ""
        x, z = (self.crossing(body, after) if after else [(0, 0)])[end]
        ids = self.encode_part(head + body[y:] + after[:z] if after else head + body[y:])
        return ids[self._size(head) if head else 0 :]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def scan(matrices: list[np.ndarray]) -> tuple[list[int], list[int]] | None:
    """(states at the chunks' ends, pieces before each chunk) of the one finite path; None where there is none or more than one.

    Products are combined in a tree; what lies before and after a chunk is handed down it.
    """
    states: list[int] = [0] * len(matrices)
    counts: list[int] = [0] * len(matrices)

    def product(lo: int, hi: int):
        if hi - lo == 1:
            return matrices[lo], None, None
        mid = (lo + hi) // 2
        a, b = product(lo, mid), product(mid, hi)
        return combine(a[0], b[0]), a, b

    ok = True

    def down(lo: int, hi: int, node, start: int, end: int, before: int) -> None:
        nonlocal ok
        if hi - lo == 1:
            states[lo], counts[lo] = end, before
            return
        _, a, b = node
        through = a[0][start] + b[0][:, end]
        k = int(through.argmax())
        ok &= int(np.isfinite(through).sum()) == 1
        if not ok:
            return
        mid = (lo + hi) // 2
        down(lo, mid, a, start, k, before)
        down(mid, hi, b, k, end, before + int(a[0][start, k]))

    root = product(0, len(matrices))
    if not np.isfinite(root[0][0, 0]):
        return None
    down(0, len(matrices), root, 0, 0, 0)
    return (states, counts) if ok else None


_LOADED: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def split(text: str, size: int, longest: int) -> list[tuple[str, str, str]]:
    """(before, body, after) of chunks of about ``size`` characters; a short last one is joined to the one before."""
    size = max(size, 4 * longest)
    at = list(range(0, len(text), size))
    if len(at) > 1 and len(text) - at[-1] < 4 * longest:
        at.pop()
    ends = [*at[1:], len(text)]
    return [(text[max(0, a - longest) : a], text[a:b], text[b : b + longest]) for a, b in zip(at, ends)]


PART = "key binary, no int, before string, body string, after string"


def _split(path: str, size: int):
    def run(batches):
        model = pieces_of(path)
        for batch in sliced(batches, 16):
            for key, text in zip(*batch.to_pydict().values()):
                parts = split(model.normalize(text), size, model.longest)
                for at in range(0, len(parts), 64):
                    rows = [(key, at + i, *p) for i, p in enumerate(parts[at : at + 64])]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.string(), pa.string(), pa.string()))], ["key", "no", "before", "body", "after"])

    return run


def _matrices(path: str):
    def run(batches):
        model = pieces_of(path)
        for batch in sliced(batches, 64):
            made = [model.matrix(*p) for p in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([m.shape[0] for m in made], pa.int32()), pa.array([m.astype("<f8").tobytes() for m in made], pa.binary())], ["key", "no", "rows", "cells"])

    return run


def _path(table: pa.Table) -> pa.Table:
    """The states of one text's chunks. Where they are not one path (never seen), state -1 asks for the text to be encoded as a whole."""
    order = np.argsort(table.column("no").to_numpy())
    cells, rows = table.column("cells").to_pylist(), table.column("rows").to_pylist()
    found = scan([np.frombuffer(cells[i], "<f8").reshape(rows[i], -1) for i in order])
    n = len(order)
    ends, counts = found or ([-1] * n, [0] * n)
    starts = [0, *ends[:-1]] if found else ends
    return pa.table({"key": table.column("key").take(pa.array([0] * n)), "no": pa.array(range(n), pa.int32()), "start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32()), "offset": pa.array(counts, pa.int64())})


IDS = "key binary, no int, offset long, ids array<int>"


def _lists(lists: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    flat = np.concatenate([np.array(x, np.int32) for x in lists]) if lists else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _between(path: str):
    def run(batches):
        model = pieces_of(path)
        for batch in sliced(batches, 64):
            cols = batch.to_pydict()
            ids = [model.between(b, t, a, s, e) if s >= 0 else [] for b, t, a, s, e in zip(cols["before"], cols["body"], cols["after"], cols["start"], cols["end"])]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cols["offset"], pa.int64()), _lists(ids)], ["key", "no", "offset", "ids"])

    return run


def _small(path: str):
    def run(batches):
        model = pieces_of(path)
        for batch in sliced(batches):
            at = batch.num_columns - 1
            ids = model.encode([t or "" for t in batch.column(at).to_pylist()])
            yield pa.record_batch([*batch.columns[:at], _lists(ids)], [*batch.schema.names[:at], "ids"])

    return run


def model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def _giant_ids(giant: DataFrame, path: str, chunk: int) -> DataFrame:
    """(key, ids) of texts (key, text) of more than one chunk."""
    parts = staged(giant.dropDuplicates(["key"]).mapInArrow(_split(path, chunk), PART), "chunks")
    spread = parts.repartition("key", "no")  # the chunks of one giant go to all tasks
    matrices = spread.mapInArrow(_matrices(path), "key binary, no int, rows int, cells binary")
    states = matrices.groupBy("key").applyInArrow(_path, "key binary, no int, start int, end int, offset long")
    states = staged(states, "states")
    got = parts.join(states, ["key", "no"]).select("key", "no", "before", "body", "after", "start", "end", "offset").mapInArrow(_between(path), IDS)
    whole = giant.join(states.where("start < 0").select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    ordered = F.array_sort(F.collect_list(F.struct("no", "ids")))
    joined = got.join(states.where("start < 0").select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
    return staged(joined.unionByName(whole.select("key", "text").mapInArrow(_small(path), "key binary, ids array<int>")), "giant-ids")


def encoded(docs: DataFrame, text_col: str = "text", path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """The documents with a column ``ids`` in the place of the text; other columns stay (one of the name ``ids`` is replaced).

    Ids are the library's of the whole text. A null text has no ids (an empty list), like an empty one. Rows may repeat. An
    empty table gives no rows.
    """
    path = path or model_path()
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "ids")]
    base = docs.select(F.struct(*rest).alias("rest") if rest else F.struct(F.lit(1).alias("x")).alias("rest"), F.col(text_col).cast("string").alias("text"))
    big = F.coalesce(F.length("text"), F.lit(0)) > chunk
    kind = base.schema["rest"].dataType.simpleString()
    small = base.where(~big).mapInArrow(_small(path), f"rest {kind}, ids array<int>")
    keyed = base.where(big).withColumn("key", text_key())
    giant = _giant_ids(keyed.select("key", "text"), path, chunk)
    large = keyed.select("rest", "key").join(giant, "key").select("rest", "ids")
    both = small.unionByName(large)
    return both.select("rest.*", "ids") if rest else both.select("ids")


def _decode(path: str):
    def run(batches):
        model = pieces_of(path)
        for batch in sliced(batches):
            at = batch.schema.get_field_index("ids")
            texts = [None if x is None else model.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.record_batch([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], ["text" if n == "ids" else n for n in batch.schema.names])

    return run


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with ``ids`` replaced by the text they spell; a null list gives a null text."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name != "ids" else "text string" for f in rows.schema)
    return rows.mapInArrow(_decode(path or model_path()), out)


def _reported(ids: np.ndarray, model: Pieces) -> tuple[int, int, int]:
    return len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(model.decode(ids.tolist()).encode("utf-8", "surrogatepass"))


def _report(path: str):
    def run(batches):
        model = pieces_of(path)
        for batch in sliced(batches):
            last = batch.column(1)
            if pa.types.is_list(last.type):
                ids = [x.values.to_numpy(zero_copy_only=False) for x in last]
            else:  # a text of one chunk
                ids = [np.array(x, np.int32) for x in model.encode([t or "" for t in last.to_pylist()])]
            rows = [_reported(x, model) for x in ids]
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ())))], ["_id", "n_pieces", "ids_crc32", "decoded_crc32"])

    return run


def encoding_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per document: (id, n_pieces, ids_crc32, decoded_crc32): the CRC-32 of the ids as little-endian 32-bit integers and of the bytes decoded from them.

    Null texts count as empty; ids of rows may be null or repeat. An empty table gives no rows.
    """
    path = path or model_path()
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, n_pieces long, ids_crc32 long, decoded_crc32 long"
    big = F.coalesce(F.length("text"), F.lit(0)) > chunk
    small = base.where(~big).mapInArrow(_report(path), schema)
    keyed = base.where(big).withColumn("key", text_key())
    giant = _giant_ids(keyed.select("key", "text"), path, chunk)
    large = keyed.select("_id", "key").join(giant, "key").select("_id", "ids").mapInArrow(_report(path), schema)
    return small.unionByName(large).withColumnRenamed("_id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_report(read(spark, sf_dir, "documents"))
