"""Embedding near-dedup by collision-counting projections.

Unit vectors are projected on many random directions. Two vectors whose cosine is the threshold differ on one direction by about
``distance / sqrt(dimensions)``; within a window of twice that around the query they collide with a known probability, and how
many of the directions collide is binomial. A pair is verified by its exact cosine if it collides on at least the count that a
pair at the threshold misses with probability MISSED.

The first projection sorts the vectors of each label over the cluster; SLAB neighbours at most are a slab. Two slabs meet if a
window on that projection reaches from one to the other; each meeting is a task of bounded size, whatever the label's share of
the rows. Within a meeting the sorted first projection enumerates each query's window neighbours, and the other projections are
counted for those only, dropping a pair once it lies beyond REACH on one of them or can no longer come to the count. A task
returns per vector how many links it found and one link to the smallest vector it is joined with, never its pairs. Equal vectors
count as one until the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read, staged, with_copies

DIRECTIONS = 24
MISSED = 1e-4
REACH = 4.2  # standard deviations of a projected difference beyond which no pair is followed
SLAB = 2000
PAIRS = 2_000_000  # pairs followed at once


def directions(dim: int) -> np.ndarray:
    """Unit directions, orthogonal as far as there are dimensions."""
    rng = np.random.default_rng([17, dim])
    rows: list[np.ndarray] = []
    while len(rows) < DIRECTIONS:
        q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        rows += list(q.T[: DIRECTIONS - len(rows)])
    return np.array(rows)


def window(dim: int, threshold: float) -> tuple[float, float, int]:
    """(half width that counts as a collision, half width beyond which no pair is followed, least count)."""
    distance = math.sqrt(max(0.0, 2 - 2 * threshold))
    if dim <= DIRECTIONS:  # few dimensions: no difference is longer than the distance, so nothing is missed
        return distance * (1 + 1e-9), distance * (1 + 1e-9), DIRECTIONS
    s = distance / math.sqrt(dim)
    p = math.erf(2 / math.sqrt(2))
    tail, least = 0.0, 0
    for k in range(DIRECTIONS):
        tail += math.comb(DIRECTIONS, k) * p**k * (1 - p) ** (DIRECTIONS - k)
        if tail > MISSED:
            break
        least = k + 1
    return 2 * s, min(REACH * s, distance * (1 + 1e-9)), least


def _vectors(batches):
    """(id, label, dim, vec): vec is the vector as doubles, null where it can link with nothing."""
    for batch in batches:
        column = batch.column(2)
        dims, vecs = [], []
        for v in column:
            x = v.values if v.is_valid else None
            a = None if x is None or len(x) == 0 or x.null_count else x.to_numpy(zero_copy_only=False).astype(np.float64)
            ok = a is not None and np.isfinite(a).all() and a.any()
            dims.append(len(a) if ok else None)
            vecs.append((a + 0.0).tobytes() if ok else None)  # + 0.0: no negative zeros
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary())], ["id", "label", "dim", "vec"])


def _unit(vecs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vecs), np.float64).reshape(len(vecs), -1)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _first(batches):
    """Adds the first projection."""
    for batch in batches:
        dims, vecs = np.array(batch.column(2).to_pylist()), batch.column(3).to_pylist()
        p = np.zeros(len(vecs))
        for d in set(dims.tolist()):
            at = np.flatnonzero(dims == d)
            p[at] = _unit([vecs[i] for i in at]) @ directions(d)[0]
        yield pa.record_batch([*batch.columns, pa.array(p)], [*batch.schema.names, "p"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node joined to it."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked(ids: np.ndarray, copies: np.ndarray, side: np.ndarray, vecs: list[bytes], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links found per vector, smallest joined id) for the pairs of side 0 with side 1, or of all where all are on side 2."""
    unit = _unit(vecs)
    dim = unit.shape[1]
    half, reach, least = window(dim, threshold)
    projected = np.ascontiguousarray((unit @ directions(dim).T).T)
    one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    two = two[np.argsort(projected[0, two], kind="stable")]
    line = projected[0, two]
    lo, hi = (np.searchsorted(line, projected[0, one] + x, side=y) for x, y in ((-reach, "left"), (reach, "right")))
    upto = np.cumsum(hi - lo)
    found_a, found_b = [], []
    at = 0
    while at < len(one):  # queries whose windows hold about PAIRS vectors together
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        size = (hi - lo)[at:stop]
        a = np.repeat(one[at:stop], size)
        b = two[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[at:stop], size)]
        at = stop
        if side.max() == 2:
            a, b = a[a < b], b[a < b]
        count = (np.abs(projected[0, a] - projected[0, b]) <= half).astype(np.uint8)
        for j in range(1, DIRECTIONS):
            apart = np.abs(projected[j, a] - projected[j, b])
            count += apart <= half
            go = (apart <= reach) & (count + (DIRECTIONS - 1 - j) >= least)
            a, b, count = a[go], b[go], count[go]
        for part in range(0, len(a), 100_000):
            x, y = a[part : part + 100_000], b[part : part + 100_000]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            found_a.append(x[near])
            found_b.append(y[near])
    a, b = (np.concatenate(f) if f else np.empty(0, np.int64) for f in (found_a, found_b))
    links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    root = _roots(len(ids), rank[a], rank[b])
    return links.astype(np.int64), ids[order][root[rank]]


def _slabs(batches):
    """Numbers runs of up to SLAB rows of one label and dimension, in partitions sorted by them and the projection."""
    part, slab, held, last = TaskContext.get().partitionId(), -1, 0, None
    for batch in batches:
        out = np.empty(batch.num_rows, np.int64)
        for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            if group != last or held == SLAB:
                slab, held, last = slab + 1, 0, group
            held += 1
            out[i] = (part << 32) + slab
        yield pa.record_batch([*batch.columns, pa.array(out)], [*batch.schema.names, "slab"])


def _meet(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        links, low = linked(ids, table.column("copies").to_numpy(), table.column("side").to_numpy(), table.column("vec").to_pylist(), threshold)
        keep = links > 0
        return pa.table({"rep": ids[keep], "links": links[keep], "low": low[keep]})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per vector: (id, n_links, component_id, kept), linking vectors of one label whose cosine is the threshold or more.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label or id, link with
    nothing; so do vectors of different lengths. Rows equal in id, label and vector count as one vector; rows that share an id
    otherwise share their links. A null id has a null component and is not kept. An empty table gives no rows.
    """
    kind = vectors.schema[label_col].dataType.simpleString()
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    made = staged(base.mapInArrow(_vectors, f"id long, label {kind}, dim int, vec binary"), "vectors")
    usable = made.where("id is not null and label is not null and vec is not null").distinct()
    same = staged(usable.groupBy("label", "dim", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("label", "rep", "dim", "vec", "copies"), "vector-classes")
    placed = staged(same.mapInArrow(_first, f"label {kind}, rep long, dim int, vec binary, copies long, p double"), "projected")
    # sorted over the cluster: a hot label takes as many partitions and slabs as it has rows for
    ranged = placed.repartitionByRange("label", "dim", "p").sortWithinPartitions("label", "dim", "p")
    slabs = staged(ranged.mapInArrow(_slabs, f"label {kind}, rep long, dim int, vec binary, copies long, p double, slab long"), "slabs")
    far = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9)
    reach = F.when(F.col("dim") <= DIRECTIONS, far).otherwise(F.least(REACH * far / F.sqrt("dim"), F.lit(far)))  # not less than window()'s
    ends = staged(slabs.groupBy("label", "dim", "slab").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).withColumn("reach", reach), "slab-ends")
    later = ends.select("label", "dim", F.col("slab").alias("two"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = ends.withColumnRenamed("slab", "one").join(later, ["label", "dim"]).where((F.col("one") <= F.col("two")) & (F.col("lo2") <= F.col("hi") + F.col("reach")) & (F.col("hi2") >= F.col("lo") - F.col("reach")))
    met = staged(met.select("one", "two"), "meeting-slabs")
    columns = ["label", "dim", "one", "two", "side", "rep", "copies", "vec"]
    own = slabs.withColumnRenamed("slab", "one").join(met, "one").withColumn("side", F.when(F.col("one") == F.col("two"), 2).otherwise(0))
    other = slabs.withColumnRenamed("slab", "two").join(met.where("one <> two"), "two").withColumn("side", F.lit(1))
    both = own.select(columns).unionByName(other.select(columns))
    found = staged(both.groupBy("label", "dim", "one", "two").applyInArrow(_meet(threshold), "rep long, links long, low long"), "meetings")
    joined = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    of_rep = joined.select(F.col("node").alias("rep"), "component")
    # a vector's links: those of its class, and the other copies in it; classes that share an id are one node of the graph
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    member = with_copies(usable, same.withColumn("rows", F.col("copies")), ["label", "dim", "vec"], "rows").select("id", "rep", "copies")
    member = member.join(links, "rep", "left").join(of_rep, "rep", "left")
    node = member.groupBy("id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component"))
    out = made.select("id").join(node, "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


SQL = """
WITH d AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM d),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.98),
c AS (SELECT a, count(*) AS n FROM e GROUP BY a),
r AS (WITH RECURSIVE t(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT t.x, e.b FROM t JOIN e ON e.a = t.y) SELECT x, min(y) AS m FROM t GROUP BY x)
SELECT g.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, r.m AS component_id, g.vec_id = r.m AS kept
FROM g JOIN r ON r.x = g.vec_id LEFT JOIN c ON c.a = g.vec_id
"""
