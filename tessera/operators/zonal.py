"""Zonal statistics over cells as rows, crosswalks of areas, coordinates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zonal_statistics(cells: DataFrame, zone: str, value: str, coverage: str, weight: str | None = None) -> DataFrame:
    """Mean and sum of the cells of each zone by coverage; with a weight the weighted mean. Sums above 1 are rounded; null weights count 0."""
    v, c = F.col(value), F.col(coverage)
    known = cells.where(v.isNotNull())
    total = F.sum(v * c)
    out = [F.count("*").alias("n_cells"), (total / F.when(F.sum(c) > 0, F.sum(c))).alias("mean"), F.when(total > 1, F.bround(total)).otherwise(total).alias("sum")]
    if weight:
        w = F.coalesce(F.col(weight), F.lit(0.0)) * c
        out.append((F.sum(v * w) / F.when(F.sum(w) > 0, F.sum(w))).alias("weighted_mean"))
    return known.groupBy(zone).agg(*out)


def weighted_median(cells: DataFrame, zone: str, value: str, coverage: str, weight: str) -> DataFrame:
    """The weighted median of each zone, interpolated between the middles of cumulative weights; cells of no weight do not count."""
    kind = dict(cells.dtypes)[zone]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf[(pdf["w"] > 0) & pdf["v"].notna()].groupby("v", sort=True)["w"].sum()
        out = None
        if len(d):
            x, w = d.index.to_numpy(float), d.to_numpy(float)
            at = (np.cumsum(w) - w / 2) / w.sum()
            out = float(np.interp(0.5, at, x))
        return pd.DataFrame({zone: [pdf[zone].iloc[0]], "weighted_median": [out]})

    base = cells.select(zone, F.col(value).cast("double").alias("v"), (F.coalesce(F.col(weight), F.lit(0)) * F.col(coverage)).cast("double").alias("w"))
    # equal values are added up before they meet in one task
    return base.groupBy(zone, "v").agg(F.sum("w").alias("w")).groupBy(zone).applyInPandas(one, f"`{zone}` {kind}, weighted_median double")


def normalized_by_zone(cells: DataFrame, zone: str, value: str) -> DataFrame:
    """Each cell's part of its zone's sum; 0 where that is none."""
    total = F.sum(value).over(Window.partitionBy(zone))
    return cells.withColumn("share", F.when(total != 0, F.col(value) / total).otherwise(0.0))


def monthly_climate(df: DataFrame, keys: list[str], date: str, means: list[str], sums: list[str]) -> DataFrame:
    """Daily values by month: mean_, min_, max_ of some columns, sum_ of others."""
    aggs = [f(c).alias(f"{n}_{c}") for c in means for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    aggs += [F.sum(c).alias(f"sum_{c}") for c in sums]
    return df.groupBy(*keys, F.trunc(date, "MM").alias("month")).agg(*aggs)


def crosswalk(overlaps: DataFrame, least: float = 0.001, major: float = 0.5, minor: float = 0.1) -> DataFrame:
    """Links of old to new areas from (old, new, area_old, area_new, area_shared).

    A link needs a part of ``least`` of the old area. The largest is primary if it has ``major`` of it; other links stay if they
    have ``minor``. Splits have several new areas, merges several old ones. Ties: the smaller new area's name.
    """
    p = overlaps.withColumn("p", F.col("area_shared") / F.col("area_old")).where(F.col("p") >= least)
    first = Window.partitionBy("old").orderBy(F.desc("p"), "new")
    p = p.withColumn("primary", (F.row_number().over(first) == 1) & (F.col("p") >= major)).where(F.col("primary") | (F.col("p") >= minor))
    old, new = Window.partitionBy("old"), Window.partitionBy("new")
    p = p.withColumns({"n_new": F.count("*").over(old), "sum_p": F.sum("p").over(old), "n_old": F.count("*").over(new)})
    return p.select("old", "new", F.bround("p", 2).alias("overlap"), "primary", "n_new", "n_old", F.bround("sum_p", 2).alias("covered"), (F.col("n_new") > 1).alias("split"), (F.col("n_old") > 1).alias("merge"))


NULLS = ("", "NA", "N/A", "NULL", "NONE", "NAN", "-")


def clean_coordinate(x: Column | str) -> Column:
    """A coordinate as a number from untidy text; null where it is none."""
    c = F.trim(F.regexp_replace(F.col(x) if isinstance(x, str) else x, " ", " "))
    c = F.when(~F.upper(c).isin(*NULLS), c)
    c = F.replace(F.replace(c, F.lit("−"), F.lit("-")), F.lit("?"), F.lit("."))
    c = F.replace(F.regexp_replace(c, "[^0-9,.-]", ""), F.lit(","), F.lit("."))
    c = F.concat(F.when(c.startswith("-"), "-").otherwise(""), F.replace(c, F.lit("-"), F.lit("")))
    c = F.regexp_replace(c, r"\.+$", "")
    whole, rest = F.regexp_extract(c, r"^([^.]*)", 1), F.regexp_extract(c, r"^[^.]*\.(.*)$", 1)
    c = F.when(c.contains("."), F.concat(whole, F.lit("."), F.replace(rest, F.lit("."), F.lit("")))).otherwise(c)
    return F.when(c != "", c).try_cast("double")


def coordinate_flags(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Adds ``coord_flag``: missing, out_of_range, zero, flipped (inside the box only with both exchanged), outside, ok."""
    x, y = F.col(lon), F.col(lat)
    west, south, east, north = box
    inside = lambda a, b: a.between(west, east) & b.between(south, north)
    flag = F.when(x.isNull() | y.isNull(), "missing").when((F.abs(x) == 0) & (F.abs(y) == 0), "zero").when(inside(x, y), "ok").when(inside(y, x), "flipped").when((F.abs(x) > 180) | (F.abs(y) > 90), "out_of_range").otherwise("outside")
    return df.withColumn("coord_flag", flag)


def coordinate_duplicates(df: DataFrame, lon: str, lat: str, digits: int = 2) -> DataFrame:
    """Rows whose rounded coordinates occur more than once."""
    out = df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumns({"x": F.bround(lon, digits), "y": F.bround(lat, digits)})
    return out.withColumn("n_same", F.count("*").over(Window.partitionBy("x", "y"))).where("n_same > 1")


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over a ring of structs (x, y), given without its first point again."""
    n = F.size(ring)

    def edge(count, i):
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        crosses = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return count + F.when(crosses & (x < at), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), edge) % 2 == 1


def points_in_zones(points: DataFrame, zones: DataFrame, x: str, y: str) -> DataFrame:
    """(point columns, zone columns but the ring): the zones (zone, ring) that contain each point; a bounding box is tested before the ring.

    Points and zones meet by equal grid cells, so neither side has to fit a broadcast. A zone is put on the grid whose cells, a power of
    two wide, are as large as its longer side, of which it covers four at most; a point has one cell on each grid in use, of which there
    are as many as there are sizes of zones. Missing coordinates lie in no zone.
    """
    corner = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    edges = {f"_{c}{i}": corner(f, c).cast("double") for c in "xy" for i, f in enumerate((F.array_min, F.array_max))}
    box = zones.select(F.struct(*(F.col(f"`{c}`") for c in zones.columns if c != "ring")).alias("_zone"), "ring").select("_zone", "ring", *(v.alias(k) for k, v in edges.items()))
    longer = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    box = box.where(longer > 0).withColumn("_level", F.ceil(F.log2(longer)).cast("int"))  # a ring without extent contains nothing
    cell = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level))
    for c in "xy":
        box = box.withColumn(f"_c{c}", F.explode(F.sequence(cell(F.col(f"_{c}0"), F.col("_level")), cell(F.col(f"_{c}1"), F.col("_level")))))
    levels = box.agg(F.collect_set("_level").alias("_levels"))  # exponents of double numbers
    at = points.select(F.struct(*(F.col(f"`{c}`") for c in points.columns)).alias("_point"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    at = at.where((F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf"))).crossJoin(F.broadcast(levels)).withColumn("_level", F.explode("_levels"))
    at = at.select("_point", "_x", "_y", "_level", cell(F.col("_x"), F.col("_level")).alias("_cx"), cell(F.col("_y"), F.col("_level")).alias("_cy"))
    near = at.join(box, ["_level", "_cx", "_cy"]).where(F.col("_x").between(F.col("_x0"), F.col("_x1")) & F.col("_y").between(F.col("_y0"), F.col("_y1")))
    return near.where(in_polygon(F.col("_x"), F.col("_y"), F.col("ring"))).select("_point.*", "_zone.*")


def ring_area(ring: Column) -> Column:
    """The area of a ring of structs (x, y), whichever way round it goes; 0 where it has fewer than three points."""
    n = F.size(ring)

    def edge(total, i):
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        return total + a["x"] * b["y"] - b["x"] * a["y"]

    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), edge)) / 2)


def _sides_cross(ring: Column) -> Column:
    """Whether two sides of a ring that do not follow each other have a point in common."""
    n = F.size(ring)
    point = lambda i: F.element_at(ring, (i - 1) % n + 1)
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    within = lambda a, b, c: c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def meet(i, j):
        a, b, c, d = point(i), point(i + 1), point(j), point(j + 1)
        s, t, u, v = turn(a, b, c), turn(a, b, d), turn(c, d, a), turn(c, d, b)
        touch = ((s == 0) & within(a, b, c)) | ((t == 0) & within(a, b, d)) | ((u == 0) & within(c, d, a)) | ((v == 0) & within(c, d, b))
        return ((s * t < 0) & (u * v < 0)) | touch

    sides = F.sequence(F.lit(1), n - 2)
    return F.when(n < 4, False).otherwise(F.exists(sides, lambda i: F.exists(F.sequence(i + 2, n), lambda j: ~((i == 1) & (j == n)) & meet(i, j))))


def polygon_checks(df: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """All rows with what their polygon and names have: n_points, area, geometry, n_same_ring, n_same_names, duplicate.

    ``geometry`` is missing (null or no points), degenerate (fewer than three points, a null coordinate or no area), crossing (two sides
    that are no neighbours meet) or ok. Rings are given without their first point again; equal ones have the same points in the same order
    from the same start. ``duplicate`` is true for rows that share both their ring and all their names with another; null names are equal.
    """
    r = F.col(f"`{ring}`")
    spare = [c for c in df.columns]
    base = df.select(F.struct(*(F.col(f"`{c}`") for c in spare)).alias("_row"), *(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), r.alias("_ring"))
    names = [f"_k{i}" for i in range(len(keys))]
    base = base.withColumn("_name", F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)).withColumn("_shape", F.sha2(F.to_json(F.struct("_ring")), 256))
    ring_ = F.col("_ring")
    blank = F.exists(ring_, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull())
    area = F.when(~blank, ring_area(ring_))
    state = F.when(ring_.isNull() | (F.size(ring_) == 0), "missing").when(blank | (F.size(ring_) < 3), "degenerate").when(_sides_cross(ring_), "crossing").when(area == 0, "degenerate").otherwise("ok")
    count = lambda *by: base.groupBy(*by).agg(F.count("*").alias("_".join(("n", *by))))
    out = base.join(count("_shape"), "_shape").join(count("_name"), "_name").join(count("_shape", "_name"), ["_shape", "_name"])
    there = F.when(state != "missing", F.col("n__shape"))
    return out.select("_row.*", F.coalesce(F.size(ring_), F.lit(0)).cast("long").alias("n_points"), area.alias("area"), state.alias("geometry"), there.alias("n_same_ring"), F.col("n__name").alias("n_same_names"), (F.col("n__shape__name") > 1).alias("duplicate"))


# A point of the compass, a sign, degrees, minutes, seconds, a point of the compass.
DMS = r"(?i)^\s*([NSEW])?\s*([-−+])?\s*(\d{1,3}(?:[.,]\d+)?)(?:(?:\s*[°º:d]\s*|\s+)(\d{1,2}(?:[.,]\d+)?)(?:(?:\s*['′’:m]\s*|\s+)(\d{1,2}(?:[.,]\d+)?))?)?\s*[°º'\"′″’”]*\s*([NSEW])?\s*$"
DMS_MARKS = r"[°º′″'\"NSEWnsew]|\d+\s+\d+"


def dms_coordinate(x: Column | str) -> Column:
    """A coordinate in degrees, minutes and seconds as a number; text without their marks is read by ``clean_coordinate``.

    South and west are negative, as is a minus. Minutes or seconds of 60 or more, and marks that do not fit the form, give null.
    """
    c = F.col(x) if isinstance(x, str) else x
    part = lambda i: F.regexp_extract(c, DMS, i)
    number = lambda i: F.coalesce(F.replace(part(i), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
    minus = part(2).isin("-", "−") | F.upper(part(1)).isin("S", "W") | F.upper(part(6)).isin("S", "W")
    size = number(3) + number(4) / 60 + number(5) / 3600
    read = F.when((part(3) != "") & (number(4) < 60) & (number(5) < 60), F.when(minus, -size).otherwise(size))
    return F.when(c.rlike(DMS_MARKS), read).otherwise(clean_coordinate(c))


def decimal_places(x: Column | str) -> Column:
    """Digits after the point of a number as text, without zeros at the end; 0 where there is no point, null for null."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNotNull(), F.length(F.rtrim(F.regexp_extract(F.trim(c), r"[.,](\d*?)0*$", 1))))
