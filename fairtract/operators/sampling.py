"""Stratified sample of an exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtract.operators.ranks import smallest
from fairtract.staging import stage


def quotas(df: DataFrame, n: int, key: str = "ST_ABBREV") -> DataFrame:
    """Rows to draw per group, in proportion to its size, by largest remainder; ties by name."""
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("size"))
    every = Window.partitionBy()
    exact = F.col("size") * F.lit(n) / F.sum("size").over(every)
    shares = sizes.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    by_remainder = Window.orderBy(F.desc(F.col("exact") - F.col("base")), key)
    left = F.lit(n) - F.sum("base").over(every)
    extra = (F.row_number().over(by_remainder) <= left).cast("bigint")
    return shares.select(key, (F.col("base") + extra).alias("quota"))


def stratified_sample(
    df: DataFrame, n: int | None, key: str = "ST_ABBREV", seed: int = 42, id_column: str = "ID", draw: Column | None = None
) -> DataFrame:
    """Exactly ``n`` rows in proportion to ``key`` if there are more, else all rows.

    Rows are ordered by a seeded hash of their id, or by the bigint ``draw``,
    so the sample does not depend on partitioning. ``n=None`` keeps everything.
    """
    if n is None or df.count() <= n:
        return df
    hashed = df.withColumn("_draw", F.xxhash64(F.col(id_column), F.lit(seed)) if draw is None else draw)
    quota = stage(quotas(df, n, key), "quotas").where(F.col("quota") > 0)
    return smallest(hashed, [key], "_draw", quota, id_column).drop("_draw")
