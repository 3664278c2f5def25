"""Adaptive bins of a numeric column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")
BUCKETS = 1 << 16


def _known(df: DataFrame, x: str) -> DataFrame:
    """Values other than null and zero; all values where nothing else is there."""
    some = df.agg(F.count(F.when(F.col(x) != 0, 1)).alias("_k"))
    return df.select(F.col(x).cast("double").alias("x")).where("x is not null").crossJoin(F.broadcast(some)).where("x <> 0 or _k = 0").select("x")


def percentiles(df: DataFrame, x: str, points: list[float], name: str) -> DataFrame:
    """One row with the exact percentiles of a double column without nulls, interpolated, as an array; null where there are no rows.

    What ``F.percentile`` gives, which holds all distinct values in one task. Here values fall into buckets of equal width, whose
    counts tell where each rank lies; only values of those buckets are counted one by one, in a sort that can spill.
    """
    span = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count("*").alias("_n"))
    share = (F.col(x) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    dealt = df.crossJoin(F.broadcast(span)).select(F.col(x).alias("_x"), F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * BUCKETS).alias("_b"))
    before = lambda by: F.coalesce(F.sum("_k").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("_b").agg(F.count("*").alias("_k")).withColumn("_from", before(Window.orderBy("_b")))  # at most BUCKETS + 1 rows
    at = span.where("_n > 0").select("_n", F.posexplode(F.array(*map(F.lit, points))).alias("_i", "_p")).withColumn("_at", (F.col("_n") - 1) * F.col("_p"))
    ranks = at.select("_i", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank"))
    within = lambda rank: (F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_k"))
    used = sizes.join(F.broadcast(ranks), within(F.col("_rank"))).select("_b", "_from").distinct()
    near = dealt.join(F.broadcast(used), "_b").groupBy("_b", "_from", "_x").agg(F.count("*").alias("_k"))
    near = near.withColumn("_from", F.col("_from") + before(Window.partitionBy("_b").orderBy("_x")))
    found = near.join(F.broadcast(ranks), within(F.col("_rank"))).groupBy("_i", "_at").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    between = (F.ceil("_at") - F.col("_at")) * F.col("_low") + (F.col("_at") - F.floor("_at")) * F.col("_high")
    value = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(between)
    made = found.agg(F.sort_array(F.collect_list(F.struct("_i", value.alias("v")))).alias("_all"))
    return made.select(F.when(F.size("_all") > 0, F.col("_all")["v"]).alias(name))


def quantile_breaks(df: DataFrame, x: str, bins: int) -> DataFrame:
    """One row with the upper bounds of ``bins`` + 1 bins of equal counts."""
    return percentiles(_known(df, x), "x", [i / (bins + 1) for i in range(1, bins + 2)], "breaks")


def hybrid_breaks(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Quantiles of the bulk (up to the 90th percentile), then everything above."""
    known = _known(df, x)
    top = percentiles(known, "x", [0.9], "q").select(F.col("q")[0].alias("q"))
    bulk = known.crossJoin(F.broadcast(top)).where("x <= q").select("x")
    return percentiles(bulk, "x", [i / bins for i in range(1, bins + 1)], "b").select(F.concat("b", F.array(F.lit(INF))).alias("breaks"))


def headtail_breaks(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Means of what lies above the mean before, until 5 % of the values or fewer are left, then everything above.

    Each step is one aggregation that runs at once and gives a single mean to the driver: as a plan of its own, each step would hold
    the steps before twice. Where that gives fewer bounds
    than ``bins``, they are the distinct quantiles of the bulk (up to the 90th percentile) in ``bins`` - 1 parts, then everything above.
    """
    known = _known(df, x)
    left, found, whole = known, [], 0
    while len(found) < bins:
        step = left.agg(F.avg("x").alias("m"), F.count("*").alias("k")).first()
        whole = whole or step.k
        if step.k <= 0.05 * whole:  # nothing at all, or few enough
            break
        found.append(step.m)
        left = known.where(F.col("x") > step.m)
    found = [*sorted(set(found)), INF]
    if len(found) >= bins or len(found) == 1:
        return df.sparkSession.range(1).select(F.array(*map(F.lit, found)).alias("breaks"))
    top = percentiles(known, "x", [0.9], "q").select(F.col("q")[0].alias("q"))
    bulk = known.crossJoin(F.broadcast(top)).where("x <= q").select("x")
    return percentiles(bulk, "x", [i / (bins - 1) for i in range(1, bins)], "b").select(F.array_distinct(F.concat("b", F.array(F.lit(INF)))).alias("breaks"))


def shape(df: DataFrame, x: str) -> DataFrame:
    """One row: the part of zeros, the 50th and 90th percentiles of the rest, their ratio and the part of the sum above the 90th; and the method they ask for.

    Many zeros, a ratio above 4 or a heavy tail ask for head/tail breaks, a ratio above 2 for hybrid ones, else quantiles do.
    """
    zero = df.where(F.col(x).isNotNull()).agg((F.count(F.when(F.col(x) == 0, 1)) / F.count("*")).alias("prop_zero"))
    known = _known(df, x)
    q = percentiles(known, "x", [0.5, 0.9], "q").select(F.col("q")[0].alias("q50"), F.col("q")[1].alias("q90")).crossJoin(F.broadcast(known.agg(F.min("x").alias("low"))))
    tail = known.crossJoin(F.broadcast(q)).groupBy("q50", "q90", "low").agg((F.sum(F.when(F.col("x") > F.col("q90"), F.col("x"))) / F.sum("x")).alias("t"))
    plain = (F.col("low") < 0) | (F.col("q50") <= 0)
    got = tail.crossJoin(F.broadcast(zero)).select("prop_zero", "q50", "q90", F.when(plain, 1.0).otherwise(F.col("q90") / F.col("q50")).alias("ratio"), F.when(plain, 0.0).otherwise(F.coalesce("t", F.lit(0.0))).alias("tail_share"))
    method = F.when((F.col("prop_zero") > 0.1) | (F.col("ratio") > 4) | (F.col("tail_share") > 0.4), "headtail").when(F.col("ratio") > 2, "hybrid").otherwise("quantile")
    return got.select(*(F.bround(c, 6).alias(c) for c in got.columns), method.alias("method"))


def bin_index(x: Column, breaks: Column) -> Column:
    """The first bin, from 1, whose upper bound is not below x; bounds belong to the bin under them."""
    return F.size(F.filter(breaks, lambda b: b < x)) + 1


def bin_counts(df: DataFrame, x: str, breaks: DataFrame) -> DataFrame:
    """Rows per bin; empty bins count 0."""
    bounds = breaks.select(F.array_sort(F.array_distinct("breaks")).alias("breaks"))
    bins = bounds.select(F.posexplode("breaks").alias("bin", "upper")).withColumn("bin", F.col("bin") + 1)
    rows = df.select(F.col(x).cast("double").alias("x")).where("x is not null").crossJoin(F.broadcast(bounds)).select(bin_index(F.col("x"), F.col("breaks")).alias("bin"))
    n = rows.groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(n, "bin", "left").select(F.col("bin").cast("long").alias("bin"), F.when(F.col("upper") < INF, F.bround("upper", 6)).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def number_label(v: float, digits: int) -> str:
    """1500 as 1.5K and 2000000 as 2M, smaller numbers with a fixed number of decimals."""
    for unit, text in ((1e6, "M"), (1e3, "K")):
        if abs(v) >= unit:
            return f"{round(v / unit, digits):.15g}{text}"
    return f"{v:.{digits}f}"


def bin_labels(low: float, breaks: list[float], whole_range: float, decimals: int = 2, round_to: float | None = 50) -> list[str]:
    """A label for each bin from the least value and the upper bounds, which are few.

    Bounds are rounded to ``round_to`` (0.05 in its place where all values lie within 2). Where two labels or the two ends of one
    would read the same, finer units are tried, then the bounds themselves with up to three more decimals.
    """
    small = whole_range <= 2
    step = 0.05 if small and round_to == 50 else round_to

    def made(unit: float | None, digits: int) -> tuple[list[str], bool]:
        at = [v if unit is None or v == INF else round(v / unit) * unit for v in (low, *breaks)]
        apart = " to " if min(at) < 0 else "–"
        ends = [(number_label(a, digits), None if b == INF else number_label(b, digits)) for a, b in zip(at, at[1:])]
        labels = [f">{a}" if b is None else f"{a}{apart}{b}" for a, b in ends]
        return labels, len(set(labels)) == len(labels) and all(a != b for a, b in ends)

    digits = decimals if small or step is None else 0
    tries, few = [(step, digits)], digits
    for part in (2, 5, 10) if step is not None else ():
        tries.append((step / part, few))
        if digits < decimals + 3:
            digits += 1
            tries.append((step / part, digits))
    tries += [(None, d) for d in range(max(digits, decimals), decimals + 4)]
    labels: list[str] = []
    for unit, d in tries:
        labels, good = made(unit, d)
        if good:
            break
    return labels


def adaptive_bins(df: DataFrame, x: str, bins: int = 6, decimals: int = 2, round_to: float | None = 50) -> DataFrame:
    """(method, bin, label, n): the method that ``shape`` asks for, its bins with labels, and the rows of each; nothing without values.

    The range, the shape and the bounds go to the driver, a row each, since labels depend on each other.
    """
    whole = df.agg(F.min(F.col(x).cast("double")).alias("lo"), F.max(F.col(x).cast("double")).alias("hi")).first()
    if whole.lo is None:
        return df.sparkSession.createDataFrame([], "method string, bin long, label string, n long")
    method = shape(df, x).first().method
    breaks = {"headtail": headtail_breaks, "hybrid": hybrid_breaks, "quantile": quantile_breaks}[method](df, x, bins)
    found = sorted(set(breaks.first().breaks))
    labels = bin_labels(whole.lo, found, whole.hi - whole.lo, decimals, round_to)
    bounds = df.sparkSession.range(1).select(F.array(*map(F.lit, found)).alias("breaks"))
    label = F.element_at(F.array(*map(F.lit, labels)), F.col("bin").cast("int"))
    return bin_counts(df, x, bounds).select(F.lit(method).alias("method"), "bin", label.alias("label"), "n")
