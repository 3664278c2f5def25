"""The driver's tables in the roles the operators ask for, each as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.activity import Roles

ROLES = Roles()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The SQL over the named tables, without views in the session's catalogue."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


#: Customers' orders as a panel: one row per order; values are taken away by rule, since the tables have no nulls.
PANEL_SQL = """
SELECT o_orderkey AS record_id, CAST(o_custkey AS {text}) AS hf, CAST(o_orderdate AS DATE) AS date, CAST(date_trunc('month', o_orderdate) AS DATE) AS yearmon,
       r_name AS adm1, n_name AS adm2,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS conf,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS test,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 11 AS DOUBLE) END AS susp
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""
PANEL = PANEL_SQL.format(text="VARCHAR", orders="orders", customer="customer", nation="nation", region="region")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("orders", "customer", "nation", "region")
    return view(spark, sf_dir, PANEL_SQL.format(text="STRING", **{n: f"{{{n}}}" for n in names}), *names)


#: Suppliers' shipped value per month, with how many lines it has.
MONTHLY_SQL = """
SELECT CAST(l_suppkey AS {text}) AS hf, n_name AS adm2, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, year(l_shipdate) AS year, month(l_shipdate) AS month,
       CASE WHEN (l_suppkey + year(l_shipdate) + month(l_shipdate)) % 13 = 0 THEN NULL
            WHEN (l_suppkey * 7 + month(l_shipdate)) % 29 = 0 THEN CAST(sum(CAST(l_quantity AS BIGINT)) * 9 AS DOUBLE) ELSE CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) END AS cases,
       CAST(count(*) AS DOUBLE) AS lines, CASE WHEN (l_suppkey + month(l_shipdate)) % 9 = 0 THEN 0.4 ELSE 0.9 END AS reprate
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
GROUP BY l_suppkey, n_name, CAST(date_trunc('month', l_shipdate) AS DATE), year(l_shipdate), month(l_shipdate)
"""
MONTHLY = MONTHLY_SQL.format(text="VARCHAR", lineitem="lineitem", supplier="supplier", nation="nation")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("lineitem", "supplier", "nation")
    return view(spark, sf_dir, MONTHLY_SQL.format(text="STRING", **{n: f"{{{n}}}" for n in names}), *names)
