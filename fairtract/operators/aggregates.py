"""Descriptions, counts, scales, histograms and fit measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtract.functions.geometry import points
from fairtract.operators.ranks import described
from fairtract.operators.select import numeric_names
from fairtract.staging import stage


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles, one row per numeric column."""
    columns = list(columns) if columns is not None else numeric_names(df, exclude=())
    more = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = described(df, columns, quartiles, more).withColumnRenamed("total", "count")
    # An all-missing column still gets a row: the list of columns drives the join.
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "variable string")
    joined = listed.join(found, "variable", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return joined.select("variable", "count", *more, *quartiles)


def count_where(df: DataFrame, flags: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(name) for name, c in flags.items()])


def _finite(c: Column) -> Column:
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def indicator_scale(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Colour scale ends over finite values: none gives 0 to 1, equal ends are widened by 1."""
    value = _finite(F.col(column))
    low, high = F.col("low"), F.col("high")
    return (
        df.groupBy(*keys)
        .agg(F.coalesce(F.min(value), F.lit(0.0)).alias("low"), F.coalesce(F.max(value), F.lit(1.0)).alias("high"))
        .withColumn("high", F.when(low == high, low + 1).otherwise(high))
        .withColumn("mid", (low + high) / 2)
    )


# Colours at the low end, the middle and the high end.
RAMP = ["#fff5f0", "#fc9272", "#67000d"]


def _channel(colour: str, i: int) -> float:
    return float(int(colour[1 + 2 * i : 3 + 2 * i], 16))


def ramp_colour(value: Column, low: Column, mid: Column, high: Column) -> Column:
    """Colour of a value on the ramp, clamped at both ends."""
    lower = F.least(F.greatest((value - low) / (mid - low), F.lit(0.0)), F.lit(1.0))
    upper = F.least(F.greatest((value - mid) / (high - mid), F.lit(0.0)), F.lit(1.0))
    parts = []
    for i in range(3):
        a, b, c = (_channel(colour, i) for colour in RAMP)
        part = F.when(value < mid, a + (b - a) * lower).otherwise(b + (c - b) * upper)
        parts.append(F.lpad(F.lower(F.hex(F.round(part).cast("bigint"))), 2, "0"))
    return F.when(value.isNotNull(), F.concat(F.lit("#"), *parts))


def choropleth(df: DataFrame, column: str) -> DataFrame:
    """Add the fill colour of each tract; the scale is one row over the whole input."""
    scale = indicator_scale(df, column).head()
    colour = ramp_colour(_finite(F.col(column)), F.lit(scale.low), F.lit(scale.mid), F.lit(scale.high))
    return df.withColumn("colour", colour)


def bounds(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bounding box of all geometries; NULL corners where there is no usable position."""
    # One fold over the positions makes a row's box, so that its text is parsed once.
    none = F.lit(None).cast("double")
    sides = ("min_lng", "min_lat", "max_lng", "max_lat")
    wider = (F.least, F.least, F.greatest, F.greatest)
    box = F.aggregate(
        F.coalesce(points(F.col("geometry")), F.array().cast("array<array<double>>")),
        F.struct(*[none.alias(side) for side in sides]),
        lambda b, p: F.struct(*[f(b[side], F.get(p, i % 2)).alias(side) for i, (f, side) in enumerate(zip(wider, sides))]),
    )
    boxes = df.select(*keys, box.alias("box")).select(*keys, "box.*")
    return boxes.groupBy(*keys).agg(
        F.min("min_lng").alias("min_lng"),
        F.min("min_lat").alias("min_lat"),
        F.max("max_lng").alias("max_lng"),
        F.max("max_lat").alias("max_lat"),
    )


def histogram(df: DataFrame, column: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the extremes of each group, last bin closed, empty bins as 0."""
    keys = list(keys)
    values = df.select(*keys, _finite(F.col(column)).alias("value")).where(F.col("value").isNotNull())
    flat = F.col("low") == F.col("high")
    ends = values.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    ends = stage(
        ends.select(
            *keys,
            F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
            F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        ).withColumn("width", (F.col("high") - F.col("low")) / bins),
        "ends",
    )
    if keys:
        placed = values.join(ends, keys)
    else:
        only = ends.head()
        placed = values.withColumns({"low": F.lit(only.low), "width": F.lit(only.width)})
    slot = F.least(F.floor((F.col("value") - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*keys, slot.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def r2_score(actual: Column, predicted: Column) -> Column:
    """Aggregate 1 - SSres/SStot; a constant outcome scores 1 if met exactly, else 0."""
    residual = F.sum((actual - predicted) * (actual - predicted))
    spread = F.var_pop(actual) * F.count(actual)
    flat = F.max(actual) == F.min(actual)
    return F.when(flat, F.when(residual == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(residual, spread))


def r2_pearson(actual: Column, predicted: Column) -> Column:
    """Aggregate squared correlation; NULL if either side is constant."""
    cross = F.covar_pop(actual, predicted)
    spread = F.var_pop(actual) * F.var_pop(predicted)
    flat = (F.max(actual) == F.min(actual)) | (F.max(predicted) == F.min(predicted))
    return F.when(~flat, F.try_divide(cross * cross, spread))


def fit_r2(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    both = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    y, p = F.col(actual), F.col(predicted)
    return both.groupBy(*keys).agg(
        F.count("*").alias("n"), r2_score(y, p).alias("r2"), r2_pearson(y, p).alias("r2_pearson")
    )
