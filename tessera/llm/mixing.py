"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts of the cells (source, language, topic) are raked: each round scales the cells so that one marginal after the other
has its target shares. A cell's factor, divided by the largest one, is the probability with which its documents are kept, so the
expected tokens of the sample have the target marginals. That ties the size of the sample to the scarcest cell. Where a budget is
given instead, cells are raked to that part of the tokens with no probability above 1: scarce values are kept as far as there are
any, the others have their shares of the budget, and a stray value costs no more than its own tokens. What is kept is decided by a hash of the id alone.

Only cells are raked; the documents are read once to count and once to sample, and meet a table of one row per cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, staged

MARGINS = ("source", "lang", "topic")
POWER = 0.8  # where no targets are given, a value's share is its share of tokens to this power, normalised
BUDGET = 0.75  # part of the tokens that a sample with a budget is raked to
ROUNDS, CUT = 20, 1  # rounds; rounds between two written tables: a plan of one round is compiled once for all
SHORT_LINE = 12  # tokens


def tokens(text: str = "text") -> Column:
    """Runs of characters other than space, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def topic(text: str = "text") -> Column:
    """A topic by plain rules: licence terms, contact data, short lines, prose; the first that holds. Null and empty texts are ``empty``."""
    t = F.col(text)
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    rules = F.when(t.isNull() | (t == ""), "empty").when(t.contains("icense") | t.contains("icence"), "licence").when(t.contains("@"), "contact")
    return rules.when(tokens(text) < SHORT_LINE * lines, "lines").otherwise("prose")


def _value(column: str) -> Column:
    """A margin's value as text that tells null from any text."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def rake(cells: DataFrame, margins: tuple[str, ...], targets: dict[str, dict[str | None, float]] | None = None, rounds: int = ROUNDS, budget: float | None = None) -> DataFrame:
    """Adds ``factor`` to cells (margins..., t): t * factor has the target shares on each margin, as far as they can be met.

    ``targets`` gives shares by value for some margins (null by None; values it does not name get none); for the others the
    shares are those of the tokens to the power POWER. A margin whose cells are all empty keeps its factors.
    With a ``budget`` the sum of t * factor is that part of all t at most, and no factor is above 1.
    """
    cells = cells.withColumn("factor", F.lit(1.0))
    for m in margins:
        given = (targets or {}).get(m)
        if given is not None:
            named = F.create_map(*(x for k, v in given.items() for x in (F.lit("null" if k is None else f"={k}"), F.lit(float(v)))))
            share = cells.select(m).distinct().select(m, F.coalesce(named[F.col(m)], F.lit(0.0)).alias("x"))
        else:
            share = cells.groupBy(m).agg(F.pow(F.sum("t").cast("double"), F.lit(POWER)).alias("x"))
        everything = share.agg(F.sum("x").alias("sx"))
        share = share.join(F.broadcast(everything)).select(m, F.coalesce(F.try_divide("x", "sx"), F.lit(0.0)).alias(f"goal_{m}"))
        cells = staged(cells.join(share, m), "goals")
    whole = cells.agg(F.sum("t").cast("double").alias("whole"))
    cells = staged(cells.join(F.broadcast(whole)), "cells")
    for r in range(rounds):
        for m in margins:
            now = F.sum(F.col("t") * F.col("factor")).over(Window.partitionBy(m))
            scaled = F.col("factor") * F.when(now > 0, F.col(f"goal_{m}") * F.col("whole") * F.lit(1.0 if budget is None else float(budget)) / now).otherwise(1.0)
            cells = cells.withColumn("factor", scaled if budget is None else F.least(scaled, F.lit(1.0)))
        if r % CUT == CUT - 1:
            cells = staged(cells, "cells")
    return cells.select(*margins, "t", "factor")


def _chance(id_col: str) -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _probabilities(docs: DataFrame, targets, budget: float | None = None) -> DataFrame:
    """(margins..., p) from documents with the margins' values and n_tokens."""
    cells = staged(docs.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("t")), "counted")
    raked = staged(rake(cells, MARGINS, targets, budget=budget), "raked")
    if budget is not None:  # cells without tokens take nothing of the budget
        return raked.select(*MARGINS, F.when((F.col("t") == 0) & (F.col("factor") > 0), 1.0).otherwise(F.col("factor")).alias("p"))
    most = raked.where("t > 0").agg(F.max("factor").alias("most"))
    return raked.join(F.broadcast(most)).select(*MARGINS, F.coalesce(F.least(F.try_divide("factor", "most"), F.lit(1.0)), F.lit(1.0)).alias("p"))


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict | None = None, budget: float | None = None) -> DataFrame:
    """One row per document: (id, n_tokens, topic, p, kept). A document is kept where the hash of its id lies under its cell's probability.

    Nulls in source and lang are a value of their own. Null and empty texts have no tokens and the topic ``empty``; where a whole
    table has no tokens, all is kept. Rows that repeat an id are kept together. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("_id"), _value("source").alias("source"), _value("lang").alias("lang"), topic(text_col).alias("topic"), tokens(text_col).alias("n_tokens"))
    joined = base.join(_probabilities(base, targets, budget), list(MARGINS))
    return joined.select(F.col("_id").alias(id_col), "n_tokens", "topic", F.round("p", 9).alias("p"), (_chance("_id") < F.col("p")).alias("kept"))


def mixed(docs: DataFrame, targets: dict | None = None, budget: float | None = None) -> DataFrame:
    """The sampled documents, with their own columns."""
    own = docs.columns
    tagged = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_doc"), _value("source").alias("source"), _value("lang").alias("lang"), topic().alias("topic"), tokens().alias("n_tokens"))
    joined = tagged.join(_probabilities(tagged, targets, budget), list(MARGINS))
    return joined.where(_chance("_doc.doc_id") < F.col("p")).select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(read(spark, sf_dir, "documents"))


def sql(documents: str = "documents") -> str:
    """The same in SQL, up to the choice of rows: CTEs up to ``mixed_docs`` (all rows, with p and kept)."""
    value = "coalesce('=' || {0}, 'null')"
    return rf"""
d0 AS (SELECT doc_id, {value.format("source")} AS source, {value.format("lang")} AS lang, text,
       len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+')) AS n_tokens,
       length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM {documents}),
d1 AS (SELECT doc_id, source, lang, CAST(n_tokens AS BIGINT) AS n_tokens,
       CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN contains(text, 'icense') OR contains(text, 'icence') THEN 'licence'
            WHEN contains(text, '@') THEN 'contact' WHEN n_tokens < {SHORT_LINE} * lines THEN 'lines' ELSE 'prose' END AS topic FROM d0),
c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS t FROM d1 GROUP BY ALL),
gs AS (SELECT source, pow(sum(t), {POWER}) AS x FROM c0 GROUP BY 1), gl AS (SELECT lang, pow(sum(t), {POWER}) AS x FROM c0 GROUP BY 1), gt AS (SELECT topic, pow(sum(t), {POWER}) AS x FROM c0 GROUP BY 1),
c1 AS (SELECT c0.*, gs.x / (SELECT sum(x) FROM gs) AS a, gl.x / (SELECT sum(x) FROM gl) AS b, gt.x / (SELECT sum(x) FROM gt) AS c, (SELECT sum(t) FROM c0) AS whole
       FROM c0 JOIN gs USING (source) JOIN gl USING (lang) JOIN gt USING (topic)),
ipf AS (WITH RECURSIVE r AS (
  SELECT 0 AS k, source, lang, topic, t, a, b, c, whole, CAST(1 AS DOUBLE) AS f FROM c1
  UNION ALL
  SELECT k + 1, source, lang, topic, t, a, b, c, whole, f * CASE WHEN s > 0 THEN c * whole / s ELSE 1 END FROM (
   SELECT *, sum(t * f) OVER (PARTITION BY topic) AS s FROM (
    SELECT k, source, lang, topic, t, a, b, c, whole, f * CASE WHEN s > 0 THEN b * whole / s ELSE 1 END AS f FROM (
     SELECT *, sum(t * f) OVER (PARTITION BY lang) AS s FROM (
      SELECT k, source, lang, topic, t, a, b, c, whole, f * CASE WHEN s > 0 THEN a * whole / s ELSE 1 END AS f FROM (
       SELECT *, sum(t * f) OVER (PARTITION BY source) AS s FROM r WHERE k < {ROUNDS}))))))
  SELECT * FROM r WHERE k = {ROUNDS}),
mixed_docs AS (SELECT d1.*, p, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < p AS kept
  FROM d1 JOIN (SELECT source, lang, topic, coalesce(least(f / (SELECT nullif(max(f), 0) FROM ipf WHERE t > 0), 1), 1) AS p FROM ipf) USING (source, lang, topic))"""


SQL = f"WITH {sql()}\nSELECT doc_id, n_tokens, topic, round(p, 9) AS p, kept FROM mixed_docs"
