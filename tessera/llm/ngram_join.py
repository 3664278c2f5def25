"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes. A set is cut at fixed places of that order into fragments.
Two sets of s and t n-grams with Jaccard at least ``num/den`` differ in at most ``(s + t) * (den - num) / (den + num)``
n-grams, so with MATCHES fragments more than that (and some to spare for empty ones) at least MATCHES of both are equal: equal
fragments give the candidates. For each
candidate pair the overlaps of coarser fragments are counted apart and summed, and the exact ratio decides.

Candidates of a group with an equal fragment are not all its pairs: first each member meets the group's lead, the member with most
equal fragments in the table (of near copies the least changed one, whatever its id).
A set that the links found leave apart in fewer groups than a link needs is done. The others are then met across components, by
the n-grams in which such sets differ most (rarest first, with the place of the first common one), so no link is lost, while
near copies of one text hardly meet. Any order of the n-grams will do for that, so rarity is read from a table of a fixed
number of counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped, read, sliced, staged

SHARDS = 8  # fragments in which overlaps are counted
GROWTH = 1.4  # sizes of one class differ by this factor at most
SPARE, EMPTY = 3, 0.06  # empty fragments of a set that need no key: this many, or this part of the fragments
LIKELY = 8  # sets meet a group's lead at once if they share this part of their keys with it
MATCHES = 4  # equal fragments of a linked pair, where sets are large enough
COUNTS = 1 << 23  # buckets in which n-grams are counted for their order, a byte each
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_WORDS: dict[bytes, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_ids(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    known = _WORDS
    if len(known) > 300_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams; the whole sequence is one where words are fewer than the width."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    ids = word_ids(words)
    n = max(1, len(ids) - width + 1)
    size = min(width, len(ids))
    h = np.full(n, np.uint64(size))
    for j in range(size):
        h = _mixed(h + ids[j : j + n] * MIX[j % len(MIX)] + np.uint64(j))
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _classes() -> np.ndarray:
    """Smallest sizes of the classes."""
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return np.array(out)


CLASSES = _classes()


def _matches(apart: int) -> int:
    """Equal fragments that a linked pair of a class has at least."""
    return 1 + min(MATCHES - 1, apart // 12)


def _fragment_keys(h: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """Keys of the fragments of one set, those of its own size class and of the class below where a partner may be there; and how many of them a link shares at least."""
    n, keys, least = len(h), [], MATCHES
    own = int(np.searchsorted(CLASSES, n, side="right")) - 1
    lowest = -(-n * num // den)
    for k in range(own, -1, -1):
        if k != own and CLASSES[k + 1] - 1 < lowest:
            break
        biggest = int(CLASSES[k + 1]) - 1  # of the smaller set of a pair that meets in class k; its partner has biggest * den / num at most
        apart = (biggest + biggest * den // num) * (den - num) // (den + num)
        least = min(least, _matches(apart))
        if not apart:  # sets of this class can only be equal
            keys.append(_mixed(np.array([h.sum()]) + np.uint64(k)))
            continue
        spare = max(min(SPARE, apart), int(EMPTY * apart) + 2 if apart >= 12 else 0)
        cuts = apart + _matches(apart) + spare
        frag = ((h >> np.uint64(32)) * np.uint64(cuts)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate(([True], frag[1:] != frag[:-1])))
        salt = np.uint64(k * 0xC2B2AE3D27D4EB4F % 2**64)
        present = _mixed(np.add.reduceat(_mixed(h + np.uint64(0x2545F4914F6CDD1D)), start) + frag[start] * MIX[0] + salt)
        if len(present) < cuts - spare:  # of the equal fragments of a pair up to spare may be empty, so that many need no key
            gone = np.setdiff1d(np.arange(cuts, dtype=np.uint64), frag[start], assume_unique=True)
            present = np.concatenate((present, _mixed(gone * MIX[2] + salt)))
        keys.append(present)
    return np.concatenate(keys).view(np.int64), least


def _summaries(width: int, num: int, den: int):
    def run(batches):
        for batch in sliced(batches):
            ids, n, digest, keys, least = batch.column(0), [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, width)
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                k, m = _fragment_keys(h, num, den) if len(h) else (np.empty(0, np.int64), 1)
                keys.append(k)
                least.append(m)
            offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            columns = [ids, pa.array(n, pa.int64()), pa.array(least, pa.int32()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            yield pa.record_batch(columns, ["id", "n", "least", "digest", "keys"])

    return run


def _shards(width: int):
    def run(batches):
        for batch in sliced(batches):
            out_id, out_shard, parts = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = shingle_hashes(text, width)
                at = np.searchsorted(h >> np.uint64(61), np.arange(SHARDS + 1, dtype=np.uint64))
                for s in range(SHARDS):
                    if at[s] < at[s + 1]:
                        out_id.append(i)
                        out_shard.append(s)
                        parts.append(h[at[s] : at[s + 1]].view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(out_id, pa.int64()), pa.array(out_shard, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "shard", "grams"])

    return run


def _linked(pairs: DataFrame, shards: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those whose Jaccard, from overlaps counted by fragment and summed, is num/den or more."""
    sides = [shards.select(F.col("id").alias(c), "shard", F.col("grams").alias(f"g{c}")) for c in "ab"]
    sides = [x.join(pairs.select(c).distinct(), c, "left_semi") for x, c in zip(sides, "ab")]
    part = pairs.join(sides[0], "a").join(sides[1], ["b", "shard"]).select("a", "b", F.size(F.array_intersect("ga", "gb")).alias("o"))
    both = part.groupBy("a", "b").agg(F.sum("o").alias("o"))
    for c in "ab":
        both = both.join(sizes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}")), c)
    return both.where(F.col("o") * den >= num * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _bucket_counts(batches):
    """How many n-grams of the partition fall in each bucket."""
    for batch in batches:
        grams = batch.column(0).flatten().to_numpy().view(np.uint64)
        some, f = np.unique(_mixed(grams) % np.uint64(COUNTS), return_counts=True)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(f)], ["bucket", "f"])


def _prefixes(num: int, den: int, counts):
    """The n-grams of each set up to the last that can be a link's first common one, rarest first, with their places."""

    def run(batches):
        for batch in sliced(batches):
            grams, at = batch.column(3), []
            for g in grams:
                h = g.values.to_numpy()
                order = np.lexsort((h, counts.value[_mixed(h.view(np.uint64)) % np.uint64(COUNTS)]))
                at.append(h[order[: len(h) - -(-len(h) * num // den) + 1]])
            size = [len(x) for x in at]
            row = pa.array(np.repeat(np.arange(len(at)), size))
            place = np.concatenate([np.arange(x) for x in size]) if size else np.empty(0, np.int64)
            yield pa.record_batch([*(batch.column(i).take(row) for i in range(3)), pa.array(place), pa.array(np.concatenate(at) if at else np.empty(0, np.int64))], ["id", "n", "c", "i", "g"])

    return run


def _rare_first(sets: DataFrame, shards: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of sets (id, n, c) of different components c that may link.

    With the n-grams of these sets ordered by rarity, a linked pair's first common n-gram leaves both enough n-grams, itself
    included, for the overlap it needs. Copies of one text differ in their rarest n-grams, so few pairs pass. The order is that
    of the counts of COUNTS buckets and then of the n-grams themselves: a table of fixed size goes to the driver and back.
    """
    whole = staged(shards.join(sets, "id").groupBy("id", "n", "c").agg(F.flatten(F.collect_list("grams")).alias("grams")), "open-sets")
    found = whole.select("grams").mapInArrow(_bucket_counts, "bucket int, f long").groupBy("bucket").agg(F.least(F.sum("f"), F.lit(255)).cast("short").alias("f")).where("f > 1").toArrow()
    counts = np.ones(COUNTS, np.uint8)
    counts[found["bucket"].to_numpy()] = found["f"].to_numpy()
    counts = sets.sparkSession.sparkContext.broadcast(counts)
    first = staged(whole.mapInArrow(_prefixes(num, den, counts), "id long, n long, c long, i long, g long"), "prefixes")
    dropped(whole)
    held = first.groupBy("g", "c").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    held = staged(held, "open-grams")  # a plain side, so that a hot n-gram's rows can be split
    every = first
    first = staged(every.join(held.select("g", F.col("top.c").alias("top")), "g"), "shared-prefixes")
    dropped(every)
    x, y = (first.select("g", "top", *(F.col(v).alias(f"{v}{k}") for v in ("id", "n", "c", "i"))) for k in "xy")
    need = F.floor((num * (F.col("nx") + F.col("ny")) + num + den - 1) / (num + den))
    # the largest component of an n-gram never meets itself
    met = x.where("cx <> top").join(y.drop("top"), "g").where((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("top")) | (F.col("idx") < F.col("idy"))))
    met = met.where((F.col("nx") - F.col("ix") >= need) & (F.col("ny") - F.col("iy") >= need))
    return met.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """One row per document: (id, n_shingles, component), linking texts whose n-gram Jaccard is num/den or more.

    Null and empty texts have 0 shingles and are linked with nothing (component = own id). Rows with a null id keep a null
    component and take part in no link. Rows that repeat an id count as one document with the union of links of its texts.
    Texts of any length are taken whole. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n long, least int, digest binary, keys array<long>"
    full = staged(base.mapInArrow(_summaries(width, num, den), schema), "sets")
    made = staged(full.select("id", "n", "digest"), "sizes")
    known = made.where("id is not null and n > 0")
    # equal sets become one: their smallest id
    same = known.groupBy("digest", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    same = staged(same, "classes")
    member = known.select("id", "digest").join(same.select("digest", "rep"), "digest").select("id", "rep")
    first = full.where("n > 0").join(same.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    sizes = same.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n"))
    posting = first.select(F.explode("keys").alias("key"), "id", "n", "least", F.size("keys").alias("m"))
    # most keys occur once: they are counted alone, and only the others are joined with their sets
    often = staged(posting.groupBy("key").agg(F.count("*").alias("f")).where("f > 1"), "met")
    raw = staged(posting.join(often, "key"), "groups")
    dropped(full)
    weight = staged(raw.groupBy("id").agg(F.sum("f").alias("weight")), "weights")
    groups = raw.drop("f")
    # ids do not choose the lead: a much changed copy as the lead would leave the others apart
    top = F.max(F.struct("weight", F.bitwise_not("id").alias("not_id")))  # of equal weights the smallest id
    met = groups.join(weight, "id").groupBy("key").agg(top.alias("top"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi")
    met = staged(met.select("key", F.bitwise_not("top.not_id").alias("lead")), "leads")

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.greatest("na", "nb") * num <= F.least("na", "nb") * den).select("a", "b").distinct()

    lead = sizes.select(F.col("id").alias("lead"), F.col("n").alias("na"))
    lone = groups.join(met.select("key", "lead"), "key").where("lead <> id").groupBy("lead", F.col("id").alias("b"), F.col("n").alias("nb"), "m").agg(F.count("*").alias("k"))
    pairs = lone.where(F.col("k") * LIKELY >= F.col("m")).select("lead", "b", "nb")  # links that have other leads or share less are met below
    pairs = near(pairs.join(lead, "lead").withColumnRenamed("lead", "a")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = staged(pairs, "pairs")
    wanted = groups.groupBy("id", "n", "least").agg(F.count("*").alias("k")).where("k >= least").select("id").distinct()
    groups = groups.drop("m")
    shards = staged(base.join(wanted, "id", "left_semi").dropDuplicates(["id", "text"]).mapInArrow(_shards(width), "id long, shard int, grams array<long>"), "shards")
    links = staged(_linked(pairs, shards, sizes, num, den), "links")
    found = components(links)
    for done in (often, weight, met):
        dropped(done)
    # members of groups that are still apart may link across their components
    tagged = groups.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", "least", F.coalesce("component", "id").alias("c"))
    tagged = staged(tagged, "tagged")
    apart = staged(tagged.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), "apart")
    open_ = tagged.join(apart, "key", "left_semi").groupBy("id", "n", "c", "least").agg(F.count("*").alias("k")).where("k >= least")
    open_ = staged(open_.select("id", "n", "c").distinct(), "open")
    more = _rare_first(open_, shards, num, den).join(pairs, ["a", "b"], "left_anti")
    more = staged(more, "more")
    if not more.isEmpty():
        links = links.unionByName(staged(_linked(more, shards, sizes, num, den), "more-links"))
        found = components(links)
    for done in (pairs, raw, tagged, apart, open_, shards, more):
        dropped(done)
    of_rep = found.select(F.col("node").alias("rep"), "component")
    placed = member.join(of_rep, "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    return made.select("id", "n").join(placed, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """Of each group of linked texts the row with the smallest id, with all its columns; rows that repeat both id and text count once.

    Rows are told apart by id and text, so a text that is linked with nothing stays whatever other texts its id has.
    Documents without words are linked with nothing and all stay, as do rows with a null id.
    """
    row = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    rows = docs.where(F.col(id_col).isNotNull()).select(row.alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = jaccard_components(rows.select("_row", "_text"), "_row", "_text", width, num, den)
    group = found.select("_row", "component_id").distinct().join(rows.select("_row", "_id").distinct(), "_row")
    stay = group.groupBy("component_id").agg(F.min(F.struct("_id", "_row"))["_row"].alias("_row")).select("_row")
    kept = docs.where(F.col(id_col).isNotNull()).withColumn("_row", row).join(stay, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


#: The same by brute force over all pairs that share a shingle.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
p AS (SELECT doc_id, unnest(sh) AS g FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * c >= 90 * (x.n_shingles + y.n_shingles - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (WITH RECURSIVE t(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.x, u.b FROM t JOIN u ON u.a = t.y) SELECT x, min(y) AS m FROM t GROUP BY x)
SELECT n.doc_id, n.n_shingles, r.m AS component_id FROM n JOIN r ON r.x = n.doc_id
"""
