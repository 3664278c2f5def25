"""What the operators share: staged tables, connected components, null-safe keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_OWN: list[str] = []  # the folder of this process, where no session names one


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='tessera-')}")
        found = _OWN[0]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back: lineage ends here, and lost executors cost no rework before it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # shuffles that only this write needed go with it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a staged table that no later step reads."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches, rows: int = 256):
    """The same rows in small batches, so that a worker never holds the Python objects of many texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_key(text: str = "text") -> F.Column:
    """16 bytes that stand for a text; null counts as the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), 1, 32))


HOT_KEYS = 256


def with_copies(rows: DataFrame, table: DataFrame, key: list[str], copies: str) -> DataFrame:
    """Rows left-joined by columns without nulls with a staged table that says by ``copies`` how many rows each of its keys has.

    The HOT_KEYS keys with most rows are broadcast, so no other key has more than 1 / HOT_KEYS of all rows; the rest is shuffled.
    """
    hot = F.broadcast(staged(table.orderBy(F.desc(copies), *key).limit(HOT_KEYS), "hot-keys"))
    few = rows.join(hot.drop(copies), key)
    rest = rows.join(hot.select(*key), key, "left_anti").join(table.drop(copies), key, "left")
    return few.unionByName(rest.select(few.columns))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of an edge the smallest node reachable from it.

    Each round joins every node to its smallest neighbour, jumps pointers once and contracts the edges, so the number of
    nodes at least halves; nothing is collected, and the hot end of a star is met only by partial sums and splittable joins.
    """
    left = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    left = staged(left, "edges")
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(left.select(F.col("b").alias("v"), F.col("a").alias("u")))
        step = staged(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), "step")
        jump = step.select(F.col("v").alias("m"), F.col("m").alias("m2"))
        step = staged(step.join(jump, "m", "left").select("v", F.coalesce("m2", "m").alias("m")), "jump")
        if labels is None:
            labels = step.select(F.col("v").alias("node"), F.col("m").alias("component"))
        else:
            moved = step.select(F.col("v").alias("component"), F.col("m").alias("to"))
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = staged(labels, "labels")
        to_a, to_b = step.select(F.col("v").alias("a"), F.col("m").alias("ma")), step.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        left = left.join(to_a, "a").join(to_b, "b").select(F.col("ma").alias("a"), F.col("mb").alias("b")).where("a <> b").distinct()
        left = staged(left, "edges")
    if labels is None:
        kind = left.schema["a"].dataType
        labels = left.select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("component"))
    return labels
