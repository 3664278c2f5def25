"""Exact substring dedup with a distributed difference-cover suffix array.

Bytes that lie in a string of ``length`` bytes which starts at two or more places are found in three steps.

1. Sample. A difference cover picks sample positions such that equal strings are sampled at equal offsets. Here the cover is
   content-defined: of each window of ``length - gram + 1`` positions the one whose ``gram``-byte string has the smallest
   hash (leftmost on ties). Every ``length``-byte string so has one anchor inside it, chosen by its bytes alone. Anchors are
   named by their gram; a name that occurs once ends the search for all windows of that anchor, which is most of the corpus.
2. Names. The windows of one anchor form one string (at most ``2 * length - gram`` bytes). Where it occurs twice as it is,
   all its windows repeat. The rest is cut into cells of ``CELL`` windows; their common core is named, and cores that occur
   once are dropped.
3. Suffix array. What is left is a reduced text: up to CELL - 1 bytes, the core's name as one symbol, up to CELL - 1 bytes.
   Its suffix array is made by the difference-cover algorithm mod 3 (sort sampled triples, recurse on names, merge the
   remaining suffixes) for each bucket of whole core groups, and adjacent suffixes with a common prefix of CELL symbols are
   the windows that repeat. A core with more than HOT cells does not fit a bucket: each of its windows is then named by
   its own bytes and counted by a plain aggregation, which has no hot task.

Names are 64- and 128-bit hashes of two independent polynomials.

Passages of some words (runs of bytes without ASCII white space) are found in the same way, with a word's hash as one symbol. An anchor
has few windows of words, so in the third step each window that is still open is named by its own words and counted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, read, sliced, staged, text_key, with_copies
from .ngram_join import word_ids

LENGTH, CELL = 400, 8
WORDS = 51  # words of a passage, where passages are told by words
PIECE = 1 << 18  # bytes hashed at once; positions must fit in 20 bits
HOT = 10_000
BUCKET = 200_000  # symbols of one suffix array
ODD = (0xD1342543DE82EF95, 0x9FB21C651E98DF25)
TABLES = [np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (11, 12)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
        done += k
    return out


class _Hashes:
    """Hashes of any substring of a buffer, from prefix sums of a polynomial mod 2**64."""

    size = 0
    up: list[np.ndarray] = []
    down: list[np.ndarray] = []

    def __init__(self, buf: np.ndarray):
        cls, n = _Hashes, len(buf)
        if cls.size < n + 1:
            cls.size = max(n + 1, PIECE + 2 * LENGTH)
            cls.up = [_powers(b, cls.size) for b in ODD]
            cls.down = [_powers(pow(b, -1, 1 << 64), cls.size) for b in ODD]
        self.sums = []
        for table, up in zip(TABLES, cls.up):
            s = np.zeros(n + 1, np.uint64)
            symbol = table[buf] if buf.dtype == np.uint8 else self._mix(buf * table[0])
            np.cumsum(symbol * up[:n], out=s[1:])
            self.sums.append(s)

    def of(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return self._mix((s[end] - s[start]) * _Hashes.down[which][start])

    def grams(self, which: int, width: int) -> np.ndarray:
        s = self.sums[which]
        return self._mix((s[width:] - s[:-width]) * _Hashes.down[which][: len(s) - width])

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h = h ^ (h >> np.uint64(29))
        h = h * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by block-wise running minima from both ends."""
    n = len(x)
    y = np.concatenate((x, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchors(buf: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, gram name, name of all windows, last window of equal runs, equal runs) for runs of windows with one anchor.

    No window crosses an end. Runs that follow each other and are equal, as in a text of one repeated byte, come once.
    """
    hashes = _Hashes(buf)
    h = hashes.grams(0, gram)
    low = np.uint64((1 << 20) - 1)
    least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    doc = np.searchsorted(ends, np.arange(len(least)), side="right")
    ok = np.arange(len(least)) + length <= ends[doc]
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new & ok)  # within a document valid windows come first, so its runs start valid
    stop = np.flatnonzero(ok & np.concatenate((new[1:] | ~ok[1:], [True])))
    at = (least[first] & low).astype(np.int64)
    g, u = h[at], hashes.of(1, first, stop + length)
    same = (g[1:] == g[:-1]) & (u[1:] == u[:-1]) & (first[1:] == stop[:-1] + 1) & (stop[1:] - first[1:] == stop[:-1] - first[:-1])
    head = np.flatnonzero(np.concatenate(([True], ~same))) if len(g) else np.empty(0, np.int64)
    tail = np.concatenate((head[1:], [len(g)]))[: len(head)] - 1
    return first[head], stop[head], at[head], g[head], u[head], stop[tail], tail - head + 1


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _words(text: str | None) -> np.ndarray:
    return word_ids((text or "").encode("utf-8", "surrogatepass").split())


def _pieces(keys, texts, copies, length: int, symbols):
    """Parts of about PIECE symbols together: (key, copies, offset of the part in its text, symbols). Longer texts go in parts that overlap by length - 1."""
    parts, held = [], 0
    for key, text, n in zip(keys, texts, copies):
        data = symbols(text)
        if len(data) < length:
            continue
        for at in range(0, len(data) - length + 1, PIECE):
            part = data[at : at + PIECE + length - 1]
            if held + len(part) > PIECE and parts:
                yield parts
                parts, held = [], 0
            parts.append((key, n, at, part))
            held += len(part)
    if parts:
        yield parts


ANCHOR = "key binary, s long, e long, p long, h long, u long, l long, n long"


def _anchor_rows(length: int, gram: int, symbols):
    def run(batches):
        for batch in sliced(batches):
            for parts in _pieces(*(batch.column(i).to_pylist() for i in range(3)), length, symbols):
                ends = np.cumsum([len(x) for *_, x in parts])
                s, e, p, h, u, l, n = anchors(np.concatenate([x for *_, x in parts]), ends, length, gram)
                doc = np.searchsorted(ends, s, side="right")
                move = (np.array([at for _, _, at, _ in parts]) - np.concatenate(([0], ends[:-1])))[doc]
                n = n * np.array([c for _, c, _, _ in parts])[doc]
                keys = pa.array([k for k, *_ in parts], pa.binary()).take(pa.array(doc))
                yield pa.record_batch([keys, *(pa.array(x + move) for x in (s, e, p)), *(pa.array(x.view(np.int64)) for x in (h, u)), pa.array(l + move), pa.array(n)], ["key", "s", "e", "p", "h", "u", "l", "n"])

    return run


CELLS = "key binary, at long, lo int, hi int, own boolean, c1 long, c2 long, left binary, right binary"


def _cell_rows(length: int):
    """Cells of the anchors listed with each text. ``at`` is where the core starts; its windows start lo..hi bytes before it."""

    def run(batches):
        for batch in sliced(batches):
            cols = batch.to_pydict()
            out: list[tuple] = []
            for key, text, runs in zip(cols["key"], cols["text"], cols["runs"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                for r in runs:
                    s, e, p, own = r["s"], r["e"], r["p"], r["own"]
                    frag = np.frombuffer(data[s : e + length], np.uint8)
                    q = np.arange((p - e) // CELL, (p - s) // CELL + 1)
                    at = p - q * CELL
                    lo, hi = np.maximum(at - e, 0), np.minimum(at - s, CELL - 1)
                    hashes = _Hashes(frag)
                    end = at + length - CELL + 1
                    c1, c2 = (hashes.of(i, at - s, end - s).view(np.int64) for i in (0, 1))
                    for a, x, y, m, n, z in zip(at.tolist(), lo.tolist(), hi.tolist(), c1.tolist(), c2.tolist(), end.tolist()):
                        out.append((key, a, x, y, own, m, n, data[a - y : a], data[z : z + CELL - 1 - x]))
                if len(out) > 4_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(out):
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["key", "at", "lo", "hi", "own", "c1", "c2", "left", "right"])

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of integers by the difference cover mod 3, in whole-array steps. At most 2**20 symbols."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(text[i:])), np.int64)
    _, sym = np.unique(text, return_inverse=True)
    sym = np.concatenate((sym.astype(np.int64) + 1, np.zeros(3, np.int64)))  # 0: beyond the end
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # where n = 3k + 1, the empty triple at n parts the halves
    sample = np.concatenate((one, two))
    triple = (sym[sample] << 42) | (sym[sample + 1] << 21) | sym[sample + 2]
    seen, name = np.unique(triple, return_inverse=True)
    rank = np.zeros(n + 3, np.int64)
    if len(seen) == len(sample):
        rank[sample] = name + 1
    else:
        rank[sample[suffix_array(name + 1)]] = np.arange(1, len(sample) + 1)
    zero = np.arange(0, n, 3)
    pair = (sym[zero] << 21) | rank[zero + 1]
    zero = zero[np.argsort(pair, kind="stable")]
    pair = (sym[zero] << 21) | rank[zero + 1]
    three = (sym[zero] << 42) | (sym[zero + 1] << 21) | rank[zero + 2]
    one, two = one[one < n], two
    one, two = one[np.argsort(rank[one])], two[np.argsort(rank[two])]
    under = np.searchsorted((sym[one] << 21) | rank[one + 1], pair) + np.searchsorted((sym[two] << 42) | (sym[two + 1] << 21) | rank[two + 2], three)
    out = np.empty(n, np.int64)
    place = np.arange(len(zero)) + under
    out[place] = zero
    rest = np.ones(n, bool)
    rest[place] = False
    sampled = np.concatenate((one, two))
    out[rest] = sampled[np.argsort(rank[sampled])]
    return out


def repeated_windows(cells: list[tuple[int, int, int, bytes, bytes]]) -> np.ndarray:
    """For cells (core name, lo, hi, left, right) a bit mask each: bit r is set where the window that starts r bytes before the core repeats."""
    lengths = np.array([len(left) + len(right) + 2 for _, _, _, left, right in cells])
    start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    text = np.empty(lengths.sum(), np.int64)
    raw = np.frombuffer(b"".join(left + b"\0" + right + b"\0" for _, _, _, left, right in cells), np.uint8)
    text[:] = raw
    left = np.array([len(c[3]) for c in cells])
    core = np.unique([c[0] for c in cells], return_inverse=True)[1]
    text[start + left] = 256 + core
    text[start + lengths - 1] = 256 + len(cells) + np.arange(len(cells))
    order = suffix_array(text)
    padded = np.concatenate((text, -1 - np.arange(CELL)))
    a, b = order[:-1], order[1:]
    for d in range(CELL):  # adjacent prefixes, dropping pairs at their first difference
        same = padded[a + d] == padded[b + d]
        a, b = a[same], b[same]
    hit = np.unique(np.concatenate((a, b)))
    cell = np.searchsorted(start, hit, side="right") - 1
    r = left[cell] - (hit - start[cell])
    mask = np.zeros(len(cells), np.int64)
    np.bitwise_or.at(mask, cell, 1 << r)
    return mask


def _leaf_rows(batches):
    """Buckets of whole core groups (rows come sorted by core) through the suffix array."""
    rows: list[tuple] = []
    symbols = 0

    def flush(part):
        mask = repeated_windows([(hash((r[5], r[6])), r[2], r[3], r[7], r[8]) for r in part])
        keep = [(r[0], r[1], int(m)) for r, m in zip(part, mask) if m and r[4]]
        if keep:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*keep), (pa.binary(), pa.int64(), pa.int64()))], ["key", "at", "mask"])

    for batch in batches:
        for row in zip(*batch.to_pydict().values()):
            if symbols > BUCKET and row[5:7] != rows[-1][5:7]:
                yield from flush(rows)
                rows, symbols = [], 0
            rows.append(row)
            symbols += len(row[7]) + len(row[8]) + 2
    if rows:
        yield from flush(rows)


def _named(texts: DataFrame, length: int, gram: int, symbols) -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """From texts (key, text, copies): runs (key, first, last) of windows that repeat as a whole, (key, runs) with the runs that are open, and the staged tables that these read."""
    anchor = staged(texts.select("key", "text", "copies").mapInArrow(_anchor_rows(length, gram, symbols), ANCHOR), "anchors")
    # both sides of this join are plain shuffles, and what follows has keys of its own: a hot gram's rows can be split
    name = staged(anchor.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "names")
    named = staged(anchor.join(name, "h", "left_semi"), "named")
    for done in (anchor, name):
        dropped(done)
    twice = named.groupBy("h", "u").agg(F.sum("n").alias("n"), F.min(F.struct("key", "s", "e", "p")).alias("one"))
    twice = staged(twice, "classes")
    whole = named.join(twice.where("n > 1").select("h", "u"), ["h", "u"], "left_semi").select("key", F.col("s").alias("first"), F.col("l").alias("last"))
    open_ = twice.where("n = 1")
    still = staged(open_.select("h").distinct(), "open-names")  # a plain side here too
    apart = twice.join(still, "h", "left_semi")
    return whole, apart.select(F.col("one.key").alias("key"), F.struct("one.s", "one.e", "one.p", (F.col("n") == 1).alias("own")).alias("r")).groupBy("key").agg(F.collect_list("r").alias("runs")), (named, twice, still)


def distinct_texts(docs: DataFrame, text_col: str, least: int) -> DataFrame:
    """(key, text, copies), a row per distinct text of that many bytes at least: nothing after it meets the copies of a text."""
    rows = docs.select(text_key(text_col).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= least)
    return staged(rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "texts")


def _window_rows(length: int):
    """Windows of words of the runs listed with each text, each named by its words."""

    def run(batches):
        for batch in sliced(batches):
            cols = batch.to_pydict()
            for key, text, runs in zip(cols["key"], cols["text"], cols["runs"]):
                data = _words(text)
                for at in range(0, len(runs), 256):
                    part = [(r["s"], r["own"], _Hashes(data[r["s"] : r["e"] + length]), np.arange(r["e"] - r["s"] + 1)) for r in runs[at : at + 256]]
                    first = np.concatenate([s + x for s, _, _, x in part])
                    own = np.concatenate([np.full(len(x), o) for _, o, _, x in part])
                    w1, w2 = (np.concatenate([h.of(i, x, x + length) for _, _, h, x in part]).view(np.int64) for i in (0, 1))
                    yield pa.record_batch([pa.array([key] * len(first), pa.binary()), pa.array(first), pa.array(own), pa.array(w1), pa.array(w2)], ["key", "first", "own", "w1", "w2"])

    return run


def repeated_passages(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(key, passages): as ``repeated_spans``, of strings of that many words; starts are counted in words."""
    whole, runs, named = _named(texts.where(F.octet_length("text") >= 2 * words - 1), words, max(1, words // 2), _words)
    window = texts.join(runs, "key").select("key", "text", "runs").mapInArrow(_window_rows(words), "key binary, first long, own boolean, w1 long, w2 long")
    window = staged(window, "windows")
    again = staged(window.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"), "again")
    single = window.where("own").join(again, ["w1", "w2"], "left_semi").select("key", "first", F.col("first").alias("last"))
    found = staged(whole.unionByName(single).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("passages")), "passages")
    for done in (window, again, *named):
        dropped(done)
    return found


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int | None = None) -> DataFrame:
    """(key, windows): for each text of ``distinct_texts`` with repeats, the runs (first, last) of starts of repeated strings."""
    gram = gram or length // 2
    if not 0 < gram < length - CELL:
        raise ValueError("a gram must be shorter than a cell's core")
    whole, runs, named = _named(texts.where(F.octet_length("text") >= length), length, gram, _bytes)
    cells = staged(texts.join(runs, "key").select("key", "text", "runs").mapInArrow(_cell_rows(length), CELLS), "cells")
    core = staged(cells.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1"), "cores")
    cold = cells.join(core.where(F.col("n") <= HOT).select("c1", "c2"), ["c1", "c2"], "left_semi").select(*cells.columns)
    leaf = cold.repartition("c1", "c2").sortWithinPartitions("c1", "c2").mapInArrow(_leaf_rows, "key binary, at long, mask long")
    bits = leaf.select("key", "at", F.explode(F.filter(F.sequence(F.lit(0), F.lit(CELL - 1)), lambda r: F.getbit("mask", r) == 1)).alias("r"))
    hot = cells.join(core.where(F.col("n") > HOT).select("c1", "c2"), ["c1", "c2"], "left_semi").select("*", F.explode(F.sequence("lo", "hi")).alias("r"))
    hot = hot.withColumn("bytes", F.concat(F.expr("substring(left, length(left) - r + 1, r)"), F.expr(f"substring(right, 1, {CELL - 1} - r)")))
    again = hot.groupBy("c1", "c2", "r", "bytes").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    hot = hot.where("own").join(again, ["c1", "c2", "r", "bytes"], "left_semi").select("key", "at", "r")
    single = bits.unionByName(hot).select("key", (F.col("at") - F.col("r")).alias("first"), (F.col("at") - F.col("r")).alias("last"))
    found = staged(whole.unionByName(single).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("windows")), "spans")
    for done in (cells, core, *named):
        dropped(done)
    return found


def merged(windows, length: int, touching: bool = True) -> list[tuple[int, int]]:
    """Maximal ranges [start, end) covered by strings of the length that start in the windows; ``touching`` ones are one."""
    out: list[list[int]] = []
    for first, last in sorted((w["first"], w["last"]) for w in windows or ()):
        if out and (first < out[-1][1] or touching and first == out[-1][1]):
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [tuple(x) for x in out]


def _kept(data: bytes, ranges) -> bytes:
    parts, at = [], 0
    for start, end in ranges:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


DIGESTS = "key binary, copies long, n_removed long, n_spans long, kept_sha256 string, n_passages long"


def _digests(length: int, words: int):
    def run(batches):
        for batch in sliced(batches):
            cols, out = batch.to_pydict(), []
            for key, copies, text, windows, passages in zip(*(cols[c] for c in ("key", "copies", "text", "windows", "passages"))):
                ranges = merged(windows, length)
                digest = hashlib.sha256(_kept(text.encode("utf-8", "surrogatepass"), ranges)).hexdigest()
                out.append((key, copies, sum(b - a for a, b in ranges), len(ranges), digest, len(merged(passages, words))))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], ["key", "copies", "n_removed", "n_spans", "kept_sha256", "n_passages"])

    return run


def _repeats(texts: DataFrame, length: int, words: int | None) -> DataFrame:
    """(key, windows, passages) of the texts that have any; passages are null where ``words`` is."""
    spans = repeated_spans(texts, length)
    if words is None:
        return spans.withColumn("passages", F.lit(None).cast("array<struct<first: long, last: long>>"))
    return spans.join(repeated_passages(texts, words), "key", "full")


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """One row per document: byte counts and the SHA-256 of what stays when all repeated strings of ``length`` bytes go.

    ``n_passages`` counts the maximal runs of words that lie in passages of ``words`` words which also start anywhere else, and
    ``repeats`` says whether the text has any repeat of either kind; passages are reported here, not removed.
    Null texts count as empty; texts shorter than the length have no repeats; a row that occurs twice is a repeat of itself.
    Ids are only carried along, so nulls and repeats among them are kept. An empty table gives no rows.
    """
    texts = distinct_texts(docs, text_col, min(length, 2 * words - 1))
    found = texts.join(_repeats(texts, length, words), "key").select("key", "copies", "text", "windows", "passages").mapInArrow(_digests(length, words), DIGESTS)
    found = staged(found, "digests")
    dropped(texts)
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("whole"))
    joined = with_copies(staged(base, "rows"), found, ["key"], "copies")
    return joined.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"),
        (F.coalesce("n_removed", F.lit(0)) + F.coalesce("n_passages", F.lit(0)) > 0).alias("repeats"),
    )


SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def _byte_ranges(data: bytes, ranges) -> list[tuple[int, int]]:
    """Ranges of words as ranges of bytes, from the first byte of the first word to the last of the last."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACES[np.frombuffer(data, np.uint8)], [True])))).tolist()
    return [(edge[2 * a], edge[2 * b - 1]) for a, b in ranges]


def _cut(length: int, words: int):
    def cut(text, windows, passages):
        data = text.encode("utf-8", "surrogatepass")
        ranges = merged(windows, length)
        if passages is not None:
            both = sorted(ranges + _byte_ranges(data, merged(passages, words, touching=False)))  # white space between two passages stays
            ranges = []
            for start, end in both:
                if ranges and start <= ranges[-1][1]:
                    ranges[-1] = (ranges[-1][0], max(ranges[-1][1], end))
                else:
                    ranges.append((start, end))
        return _kept(data, ranges).decode("utf-8", "ignore")

    def run(batches):
        for batch in sliced(batches):
            texts = list(map(cut, *(batch.column(i).to_pylist() for i in (1, 2, 3))))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["_key", "_cut"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """The documents with repeated bytes cut out of ``text`` (a character of which a part is cut goes with it); all rows stay, other columns are untouched.

    Where ``words`` is given, passages of that many words that repeat go as well, however few bytes they have.
    Columns named ``_key`` or ``_cut`` are kept as any other.
    """
    texts = distinct_texts(docs, "text", length if words is None else min(length, 2 * words - 1))
    found = texts.join(_repeats(texts, length, words), "key").select("key", "text", "windows", "passages").mapInArrow(_cut(length, words or WORDS), "_key binary, _cut string")
    found = staged(found, "cut-texts")  # a plain side, so that the rows of a hot text can be split
    dropped(texts)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), text_key().alias("_key"))
    joined = whole.join(found, "_key", "left")
    return joined.select(*(F.coalesce("_cut", "_doc.text").alias(c) if c == "text" else F.col(f"_doc.`{c}`") for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(read(spark, sf_dir, "documents"))
