"""Joins of the tract table with geometry, index, drivers and state codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtract.functions.scalars import geoid11_int, state_fips, to_numeric_or_null


def join_geometry(indicators: DataFrame, geometry: DataFrame, key: str | None = None) -> DataFrame:
    """Tracts that have a boundary; a ``GEOID`` that is no number matches nothing.

    ``key`` names a column of the padded id that both sides have; tables stored in buckets
    of it (``sources.buckets``) are joined without a shuffle, here and below.
    """
    shapes = geometry.withColumn("GEOID", to_numeric_or_null(F.col("GEOID")))
    if key:
        return indicators.join(shapes, key, "inner")
    return indicators.join(shapes, F.col("ID") == F.col("GEOID"), "inner")


def join_index(indicators: DataFrame, index: DataFrame, key: str | None = None) -> DataFrame:
    """All tracts, with the index columns where the padded id is found."""
    if key:
        return indicators.join(index.drop("GEOID"), key, "left").withColumn("GEOID", F.col(key))
    right = index.withColumn("GEOID", F.trim("GEOID"))
    return indicators.withColumn("GEOID", geoid11_int(F.col("ID"))).join(right, "GEOID", "left")


def match_report(joined: DataFrame, column: str = "RPL_EJI") -> DataFrame:
    return joined.agg(
        F.count(F.col(column)).alias("matched"), F.count("*").alias("total")
    )


def attach_ids(results: DataFrame, base: DataFrame, columns: list[str], key: str = "ID") -> DataFrame:
    """Bring id columns back to a result that only carries the key."""
    return base.select(key, *[c for c in columns if c != key]).join(results, key, "inner")


def attach_drivers(tracts: DataFrame, drivers: DataFrame, key: str | None = None) -> DataFrame:
    """Driver lists per tract, NULL where there is no record."""
    lists = drivers.select("geoid11", "cancer", "resp")
    if key:
        return tracts.join(lists.withColumnRenamed("geoid11", key), key, "left")
    return tracts.withColumn("geoid11", geoid11_int(F.col("ID"))).join(lists, "geoid11", "left")


def attach_state(ids: DataFrame, fips: DataFrame, geoid: str = "geoid11") -> DataFrame:
    """State of each id by its FIPS prefix; an unknown code gives NULL.

    The code table has at most one row per two-digit code, and Spark
    broadcasts it only while it is under its own size threshold.
    """
    return ids.withColumn("fips", state_fips(F.col(geoid))).join(fips, "fips", "left")
