"""Nested demography documents from tables of areas and ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def age_distribution(df: DataFrame, country: str, year: int) -> DataFrame:
    """(age_days, cumulative share) of the country in the nearest year (the earlier on ties). Population is in thousands.

    The country is found by its name without regard to case; where none is equal, by a part of the name.
    """
    name = F.lower("country")
    exact = F.max((name == country.lower()).cast("int")).over(Window.partitionBy(F.lit(1)))
    rows = df.where(name.contains(country.lower())).withColumn("_e", exact).where((F.col("_e") == 0) | (name == country.lower()))
    near = rows.agg(F.min_by("year", F.struct(F.abs(F.col("year") - year), F.col("year"))).alias("_y"))
    at = rows.crossJoin(F.broadcast(near)).where("year = _y").groupBy("age").agg((F.sum("pop") * 1000).alias("pop"))
    whole = F.sum("pop").over(Window.partitionBy(F.lit(1)))  # one row per year of age
    upto = Window.partitionBy(F.lit(1)).orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    return at.select((F.col("age") * 365).alias("age_days"), F.bround(F.sum("pop").over(upto) / whole, 9).alias("share"))


def node_document(node_id: Column, name: Column, lat: Column, lon: Column, population: Column, birth_rate: Column) -> Column:
    """The document of one area as a struct; the birth rate is per thousand and year, and is stored per person and day."""
    attributes = F.struct(lat.alias("Latitude"), lon.alias("Longitude"), population.alias("InitialPopulation"), (birth_rate / 1000 / 365).alias("BirthRate"), name.alias("FacilityName"))
    node = F.struct(node_id.alias("NodeID"), attributes.alias("NodeAttributes"))
    return F.struct(F.struct(F.lit("Legacy").alias("IdReference"), F.lit(1).alias("NodeCount")).alias("Metadata"), F.array(node).alias("Nodes"))


def documents(df: DataFrame) -> DataFrame:
    """(name, json): one document per area of (node_id, name, lat, lon, pop, birth_rate); folder names keep letters, digits and dashes."""
    doc = node_document(*(F.col(c) for c in ("node_id", "name", "lat", "lon", "pop", "birth_rate")))
    return df.select(F.regexp_replace("name", "[^A-Za-z0-9-]+", "_").alias("folder"), F.to_json(doc).alias("json"))
