"""Facility matching and administrative-name harmonisation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nearness import most_similar, nearest
from ..functions.semantics import null_safe_join, require
from ..functions.text import clean_name, standardize_name

SIDE = 2_000  # names on a side of a tile
RANKS = {"exact_admin": 1, "standardized": 2, "fuzzy": 3, "unmatched": 4, "missing_name": 5}


def match_facilities(target: DataFrame, lookup: DataFrame, admins: list[str], threshold: float = 95.0, one_to_one: bool = True) -> DataFrame:
    """Matches target names (admins, uid, hf) to lookup names (admins, hf_mfl) within equal admins, in stages.

    Equal upper-case names score 100, then equal standard forms; what is left takes its best candidate by the mean of Jaro and edit
    similarity, if that reaches the threshold. Equal admins block the comparison, of distinct standard forms in tiles; targets matched
    in a stage leave the next.
    With one_to_one the best target keeps a lookup name and the others become unmatched. Ties: the smaller name, then uid.
    """
    require(target, [*admins, "uid", "hf"])
    require(lookup, [*admins, "hf_mfl"])
    t = target.select(*admins, "uid", "hf").distinct()
    named = t.where("hf is not null").withColumns({"std": standardize_name("hf"), "up": F.upper("hf")})
    mfl = lookup.select(*admins, "hf_mfl").where("hf_mfl is not null").distinct().withColumns({"std_mfl": standardize_name("hf_mfl"), "up_mfl": F.upper("hf_mfl")})

    def best(pairs: DataFrame, score: str, method: str) -> DataFrame:
        order = Window.partitionBy(*admins, "uid").orderBy(F.desc(score), "hf_mfl")
        got = pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1")
        return got.select(*admins, "uid", "hf", F.lit(method).alias("match_method"), F.bround(score).cast("int").alias("match_pct"), "hf_mfl")

    on = lambda a, b: [*(named[k].eqNullSafe(mfl[k]) for k in admins), a == b]
    both = lambda df: df.select(*(named[k] for k in admins), "uid", "hf", "std", "hf_mfl", "std_mfl")
    exact = best(both(named.join(mfl, on(named["up"], mfl["up_mfl"]))).withColumn("s", F.lit(100.0)), "s", "exact_admin")
    keys = [*admins, "uid"]
    left = _without(named, exact, keys)
    std = best(both(named.join(mfl, on(named["std"], mfl["std_mfl"]))).withColumn("s", F.lit(100.0)), "s", "standardized")
    std = _without(std, exact, keys)
    rest = _without(left, std, keys)
    forms = mfl.groupBy(*admins, "std_mfl").agg(F.min("hf_mfl").alias("hf_mfl"))
    kinds = {f.name: f.dataType.simpleString() for f in rest.select(*admins).schema}

    def compared(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("hf_mfl", ignore_index=True)
        i, j, score = most_similar(x["std"].tolist(), y["std_mfl"].tolist(), threshold)
        return x.iloc[i][[*admins, "std"]].assign(hf_mfl=y["hf_mfl"].to_numpy()[j], s=score)

    scored = _in_tiles(rest.select(*admins, "std").distinct(), forms, admins, "std", "std_mfl", compared, {**kinds, "std": "string", "hf_mfl": "string", "s": "double"})
    fuzzy = best(null_safe_join(rest.select(*admins, "uid", "hf", "std"), scored, [*admins, "std"], "inner"), "s", "fuzzy")
    found = exact.unionByName(std).unionByName(fuzzy)
    if one_to_one:
        rank = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[F.col("match_method")]
        order = Window.partitionBy(*admins, "hf_mfl").orderBy(F.desc("match_pct"), rank, "uid")
        found = found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    none = _without(t, found, keys)
    none = none.select(*admins, "uid", "hf", F.when(F.col("hf").isNull(), "missing_name").otherwise("unmatched").alias("match_method"), F.lit(None).cast("int").alias("match_pct"), F.lit(None).cast("string").alias("hf_mfl"))
    return found.unionByName(none).withColumn("match_status", match_status(F.col("match_pct")))


def _without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    other = gone.select(*(F.col(k).alias(f"_{k}") for k in keys))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return df.join(other, on, "left_anti")


def _in_tiles(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, compared: Callable, schema: dict[str, str]) -> DataFrame:
    """What ``compared`` makes of the rows of both sides under equal keys (null as a key too), about SIDE rows of each at a time.

    Both sides of a block are dealt by the hash of their names, and every part of the one meets every part of the other, so a task
    holds a tile and not a block. The tiles are many more than bytes would ask for, since the comparing takes the time.
    """
    parts = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count("*") / SIDE).cast("int").alias(n))
    grid = null_safe_join(parts(left, "_m"), parts(right, "_n"), keys, "inner")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    x = null_safe_join(left, grid, keys, "inner").select(*left.columns, F.pmod(F.xxhash64(a), F.col("_m")).cast("int").alias("_i"), every("_n").alias("_j"))
    y = null_safe_join(right, grid, keys, "inner").select(*right.columns, F.pmod(F.xxhash64(b), F.col("_n")).cast("int").alias("_j"), every("_m").alias("_i"))
    spark, tile = left.sparkSession, [*keys, "_i", "_j"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = [df.repartition(n, *tile).groupBy(*tile) for df in (x, y)]
    some = lambda p, q: compared(p, q) if len(p) and len(q) else pd.DataFrame({c: [] for c in schema})
    return dealt[0].cogroup(dealt[1]).applyInPandas(some, ", ".join(f"`{c}` {kind}" for c, kind in schema.items()))


def match_status(pct):
    """high from 95, medium from 80, low from 70."""
    return F.when(pct >= 95, "high").when(pct >= 80, "medium").when(pct >= 70, "low").when(pct.isNotNull(), "very low").otherwise("unmatched")


def coverage(matched: DataFrame, lookup: DataFrame) -> DataFrame:
    """Distinct rows of the lookup with a name and how many of them are matched, by name in any admin unit."""
    names = lookup.where("hf_mfl is not null").distinct().select("hf_mfl")
    hit = matched.where("hf_mfl is not null").select("hf_mfl").distinct().withColumn("hit", F.lit(1))
    got = names.join(hit, "hf_mfl", "left").agg(F.count("*").alias("n_lookup"), F.count("hit").alias("n_matched"))
    return got.select("n_lookup", "n_matched", (F.col("n_lookup") - F.col("n_matched")).alias("n_only_lookup"), F.bround(100 * F.try_divide(F.col("n_lookup") - F.col("n_matched"), F.col("n_lookup")), 4).alias("pct_only_lookup"))


def apply_decisions(df: DataFrame, decisions: DataFrame, levels: list[str]) -> DataFrame:
    """Replaces names level by level by a table (level, name_to_match, replacement), after cleaning both sides; names without a decision stay.

    Where the table has columns of upper levels as well, a decision holds under its parents only, which are compared with the parents
    as corrected so far; a null parent stands for any. The decision with more parents wins, then the smaller replacement.
    """
    out = df
    for i, level in enumerate(levels):
        parents = [p for p in levels[:i] if p in decisions.columns]
        named = decisions.where(F.col("level") == level).select(clean_name("name_to_match").alias("_name"), clean_name("replacement").alias("_to"), *(clean_name(p).alias(f"_{p}") for p in parents))
        out = out.withColumn(level, clean_name(level))
        for known in sorted(product((True, False), repeat=len(parents)), key=sum, reverse=True):  # which parents a decision names
            some = named.where(reduce(lambda a, b: a & b, (F.col(f"_{p}").isNotNull() == k for p, k in zip(parents, known)), F.lit(True)))
            by = [p for p, k in zip(parents, known) if k]
            some = some.groupBy("_name", *(f"_{p}" for p in by)).agg(F.min("_to").alias("_to"))
            on = reduce(lambda a, b: a & b, (F.col(p) == F.col(f"_{p}") for p in by), F.col(level) == F.col("_name"))
            found = F.coalesce("_found", "_to") if "_found" in out.columns else F.col("_to")
            out = out.join(some, on, "left").withColumn("_found", found).drop("_name", "_to", *(f"_{p}" for p in by))
        out = out.withColumn(level, F.coalesce("_found", level)).drop("_found")
    return out


def match_stats(df: DataFrame, lookup: DataFrame, levels: list[str]) -> DataFrame:
    """Per level: distinct target names (with their parents), distinct lookup names, and target names that the lookup has."""
    out = []
    for i, level in enumerate(levels):
        key = F.concat_ws("_", *(clean_name(c) for c in levels[: i + 1]))
        a = df.select(key.alias("k")).distinct()
        b = lookup.select(key.alias("k"), F.lit(1).alias("hit")).distinct()
        got = a.join(b, "k", "left").agg(F.count("*").alias("n_target"), F.count("hit").alias("n_matched"))
        out.append(got.crossJoin(b.agg(F.count("*").alias("n_lookup"))).select(F.lit(level).alias("level"), "n_target", "n_lookup", "n_matched"))
    return reduce(DataFrame.unionByName, out)


def impute_parent(df: DataFrame, lookup: DataFrame, child: str, parent: str) -> DataFrame:
    """The parent of each child by the lookup; a child without one keeps its own name as the parent."""
    pairs = lookup.groupBy(F.col(child).alias("_c")).agg(F.min(parent).alias("_p"))
    return df.join(pairs, F.col(child) == F.col("_c"), "left").withColumn(f"{parent}_imputed", F.coalesce("_p", child)).drop("_c", "_p")


def nearest_names(names: DataFrame, candidates: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest distinct candidates of each distinct name in its block, by Levenshtein distance of standard forms, then by name."""
    named = names.select("block", "name").where("block is not null and name is not null").distinct().withColumn("std", standardize_name("name"))
    known = candidates.select("block", "candidate").where("block is not null and candidate is not null").distinct().withColumn("std_candidate", standardize_name("candidate"))

    def compared(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        y = y.sort_values("candidate", ignore_index=True)
        i, j, d = nearest(x["std"].tolist(), y["std_candidate"].tolist(), k)
        return x.iloc[i][["block", "std"]].assign(candidate=y["candidate"].to_numpy()[j], distance=d)

    kind = named.select("block").schema[0].dataType.simpleString()
    near = _in_tiles(named.select("block", "std").distinct(), known, ["block"], "std", "candidate", compared, {"block": kind, "std": "string", "candidate": "string", "distance": "long"})
    order = Window.partitionBy("block", "std").orderBy("distance", "candidate")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return named.join(near, ["block", "std"]).select("block", "name", "candidate", "distance", F.col("rank").cast("long").alias("rank"))
