"""Exact ranks and quantiles within groups of any size.

A window ordered by value would put a whole group into one task, and a group
may hold a third of all rows. Here the distinct values of all groups are
counted, range-partitioned together, and each slice gets the number of rows
before it. The only windows run inside one slice or over the slices of one
group, so work is spread evenly however the rows are distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtract.staging import stage


def melt(df: DataFrame, carry: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per carried columns and variable; missing and NaN values are left out."""
    long = df.select(*carry, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(carry), list(columns), "variable", "value"
    )
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def cumulative_counts(long: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """For each distinct value of a group: ``ties`` rows equal, ``below`` rows less, ``total`` rows in all.

    ``value`` may have any ordered type. Groups with a NULL key are left out.
    """
    usable = F.lit(True)
    for c in [*keys, value]:
        usable = usable & F.col(c).isNotNull()
    return accumulate(long.where(usable).groupBy(*keys, value).agg(F.count("*").alias("ties")), keys, value)


def accumulate(counts: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Running totals of counted values (``keys, value, ties``), as in ``cumulative_counts``."""
    keys = list(keys)
    slices = stage(
        counts.repartitionByRange(*keys, value).withColumn("slice", F.spark_partition_id()), "slices"
    )
    along = Window.partitionBy(*keys).orderBy("slice")
    sizes = (
        slices.groupBy(*keys, "slice")
        .agg(F.sum("ties").alias("size"))
        .withColumn("before", F.sum("size").over(along) - F.col("size"))
        .withColumn("total", F.sum("size").over(Window.partitionBy(*keys)))
        .drop("size")
    )
    # The slice and, below, the value come first among the keys: sorts compare leading columns fastest.
    inside = (
        Window.partitionBy("slice", *keys)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        slices.join(sizes, ["slice", *keys])
        .withColumn("below", F.col("before") + F.sum("ties").over(inside) - F.col("ties"))
        .select(*keys, value, "ties", "below", "total")
    )


def average_rank() -> Column:
    return F.col("below") + (F.col("ties") + 1) / F.lit(2.0)


def percent_rank() -> Column:
    return F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(F.lit(0.0))


def rank_columns(
    df: DataFrame,
    row: Sequence[str],
    columns: Sequence[str],
    rank: Column,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Replace each column by its rank within ``keys``.

    ``row`` columns are kept; they must include ``keys``. Missing values, and
    those of rows with a missing key, get no rank. Each row is ranked, also
    if others are equal to it: rows are numbered in a stored copy.

    The values of all columns are sorted by range together, the row number
    last, so that also a value of very many rows is dealt over slices. A slice
    ranks its own rows; what lies before it, and how far the values at its two
    ends reach into others, comes from a small table of slices.
    """
    keys = list(keys)
    numbered = stage(df.select(*row, *columns, F.monotonically_increasing_id().alias("_row")), "numbered")
    groups = [*keys, "variable"]
    long = melt(numbered, ["_row", *keys], columns)
    for k in keys:
        long = long.where(F.col(k).isNotNull())
    sliced = long.repartitionByRange(*groups, "value", "_row").withColumn("slice", F.spark_partition_id())
    sliced = stage(sliced, "slices")
    # Slice and value lead, as sorts compare leading columns fastest.
    inside = Window.partitionBy("slice", *groups)
    local = sliced.withColumns(
        {
            "local_below": F.rank().over(inside.orderBy("value")) - 1,
            "local_ties": F.count("*").over(Window.partitionBy("slice", *groups, "value")),
        }
    )
    ends = stage(_slice_ends(sliced, groups), "ends")
    at_end = F.when(F.col("value") == F.col("low"), F.col("at_low")).when(F.col("value") == F.col("high"), F.col("at_high"))
    placed = (
        local.join(ends, ["slice", *groups])
        .withColumn("at_end", at_end)
        .withColumn("below", F.coalesce(F.col("at_end.below"), F.col("before") + F.col("local_below")))
        .withColumn("ties", F.coalesce(F.col("at_end.ties"), F.col("local_ties")))
    )
    wide = (
        placed.select("_row", "variable", rank.alias("rank"))
        .groupBy("_row")
        .agg(*[F.max(F.when(F.col("variable") == c, F.col("rank"))).alias(c) for c in columns])
    )
    return numbered.select("_row", *row).join(wide, "_row", "left").select(*row, *columns)


def _slice_ends(sliced: DataFrame, groups: list[str]) -> DataFrame:
    """Per slice and group: rows ``before`` it, the group's ``total``, and for its lowest and
    highest value the rows of the whole group ``below`` it and its ``ties``."""
    counts = sliced.groupBy("slice", *groups, "value").agg(F.count("*").alias("n"))
    per_slice = counts.groupBy("slice", *groups).agg(
        F.sum("n").alias("size"),
        F.min(F.struct("value", "n")).alias("first"),
        F.max(F.struct("value", "n")).alias("last"),
    )
    along = Window.partitionBy(*groups).orderBy("slice")
    whole = Window.partitionBy(*groups)
    spans = (
        per_slice.withColumn("before", F.sum("size").over(along) - F.col("size"))
        .withColumn("total", F.sum("size").over(whole))
    )
    # The rows below a value end where its first slice has it: at the front, or else at the back.
    front = F.struct(F.col("first.value").alias("value"), F.col("first.n").alias("n"), F.col("before").alias("below"))
    back = F.struct(
        F.col("last.value").alias("value"), F.col("last.n").alias("n"), (F.col("before") + F.col("size") - F.col("last.n")).alias("below")
    )
    both = F.when(F.col("first.value") == F.col("last.value"), F.array(front)).otherwise(F.array(front, back))
    values = (
        spans.select(*groups, F.explode(both).alias("e"))
        .groupBy(*groups, F.col("e.value").alias("value"))
        .agg(F.min("e.below").alias("below"), F.sum("e.n").alias("ties"))
        .select(*groups, "value", F.struct("below", "ties").alias("at"))
    )
    low = values.withColumnsRenamed({"value": "low", "at": "at_low"})
    high = values.withColumnsRenamed({"value": "high", "at": "at_high"})
    return (
        spans.select("slice", *groups, "before", "total", F.col("first.value").alias("low"), F.col("last.value").alias("high"))
        .join(low, [*groups, "low"])
        .join(high, [*groups, "high"])
    )


# Groups up to SMALL rows fit the built-in exact aggregate. For larger ones a KLL sketch of SKETCH items places a
# bracket; MARGIN, its half width relative to the group, is the sketch's rank error at 99 % confidence.
SMALL = 50_000
SKETCH = 4_096
MARGIN = 2.296 / SKETCH**0.9021


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: dict[str, float],
    keys: Sequence[str] = (),
    small: int | None = None,
) -> DataFrame:
    """Interpolated quantiles, one row per group and variable, one column per named probability.

    A first pass counts the values of each group. Groups up to ``small`` rows (default ``SMALL``) use the built-in
    exact aggregate, whose buffer grows with the group. In large ones a mergeable sketch gives a narrow
    bracket around each quantile; only values inside it are ranked, together with the number of rows below
    it, so no large group is shuffled or sorted.
    """
    totals = stage(_totals(df, columns, list(keys), {}), "totals")
    return _quantiles(df, columns, totals, probabilities, list(keys), SMALL if small is None else small)


def _quantiles(df: DataFrame, columns: Sequence[str], totals: DataFrame, probabilities: dict[str, float], keys: list[str], most: int) -> DataFrame:
    """Quantiles of the groups and variables of ``totals`` (``keys, variable, total``)."""
    groups = [*keys, "variable"]
    large = totals.where(F.col("total") > most).select(*groups, "total")
    if large.isEmpty():
        return _small_quantiles(df, columns, probabilities, keys)
    brackets = stage(_brackets(df, columns, probabilities, keys, large), "brackets")
    long = melt(df, keys, columns)
    found = _large_quantiles(long, brackets, groups)
    wide = found.groupBy(*groups).agg(
        *[F.max(F.when(F.col("q") == name, F.col("quantile"))).alias(name) for name in probabilities]
    )
    small = totals.where((F.col("total") <= most) & (F.col("total") > 0)).select(*groups)
    if small.isEmpty():
        return wide
    rows = long.join(small, groups, "left_semi")
    exact = rows.groupBy(*groups).agg(F.percentile("value", list(probabilities.values())).alias("found"))
    return wide.unionByName(exact.select(*groups, *[F.get("found", F.lit(i)).alias(name) for i, name in enumerate(probabilities)]))


def _usable(c: str) -> Column:
    """Values that count: numbers, neither missing nor NaN."""
    number = F.col(c).cast("double")
    return F.when(~F.isnan(number), number)


def _long(df: DataFrame, columns: Sequence[str], keys: list[str], aggregates: dict) -> DataFrame:
    """Aggregates of each column (functions of its usable values) in one pass: ``keys, variable`` and one column each."""
    cells = [f(_usable(c)).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in aggregates.items()]
    entries = [
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{name}_{i}").alias(name) for name in aggregates])
        for i, c in enumerate(columns)
    ]
    return df.groupBy(*keys).agg(*cells).select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def _totals(df: DataFrame, columns: Sequence[str], keys: list[str], more: dict) -> DataFrame:
    return _long(df, columns, keys, {"total": F.count, **more})


def _small_quantiles(df: DataFrame, columns: Sequence[str], probabilities: dict[str, float], keys: list[str]) -> DataFrame:
    exact = _long(df, columns, keys, {"found": lambda v: F.percentile(v, list(probabilities.values()))})
    names = [F.get("found", F.lit(i)).alias(name) for i, name in enumerate(probabilities)]
    return exact.where(F.col("found").isNotNull()).select(*keys, "variable", *names)


def _large_quantiles(long: DataFrame, brackets: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, q, quantile``. Should a bracket miss, its group is ranked whole."""
    near = long.join(brackets.select(*groups, "q", "low", "high"), groups).where(F.col("value") <= F.col("high"))
    # Values below the bracket become one NULL per group, so that they are only counted.
    inside = F.when(F.col("value") >= F.col("low"), F.col("value"))
    cells = stage(near.groupBy(*groups, "q", inside.alias("value")).agg(F.count("*").alias("ties")), "cells")
    under = cells.where(F.col("value").isNull()).select(*groups, "q", F.col("ties").alias("under"))
    ranked = (
        accumulate(cells.where(F.col("value").isNotNull()), [*groups, "q"])
        .drop("total")
        .join(brackets.drop("low", "high"), [*groups, "q"], "right")
        .join(under, [*groups, "q"], "left")
        .withColumn("below", F.col("below") + F.coalesce("under", F.lit(0)))
    )
    found = stage(_interpolated(ranked, [*groups, "q"]), "quantiles")
    missed = found.where(F.col("quantile").isNull())
    if missed.isEmpty():
        return found
    return found.where(F.col("quantile").isNotNull()).unionByName(_whole(long, missed, brackets, groups))


def _brackets(
    df: DataFrame, columns: Sequence[str], probabilities: dict[str, float], keys: list[str], large: DataFrame
) -> DataFrame:
    """``keys, variable, q, p, total, low, high`` of the large groups: sketches of all columns in one pass."""
    rows = df.join(large.select(*keys).distinct(), keys, "left_semi") if keys else df
    sketches = _long(rows, columns, keys, {"sketch": lambda v: F.kll_sketch_agg_double(v, F.lit(SKETCH))})
    ends = [max(0.0, p - MARGIN) for p in probabilities.values()] + [min(1.0, p + MARGIN) for p in probabilities.values()]
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, ends)))
    asked = [
        F.struct(F.lit(name).alias("q"), F.lit(float(p)).alias("p"), F.lit(j).alias("i"))
        for j, (name, p) in enumerate(probabilities.items())
    ]
    return (
        sketches.join(large, [*keys, "variable"])
        .select(*keys, "variable", "total", found.alias("ends"), F.explode(F.array(*asked)).alias("a"))
        .select(
            *keys,
            "variable",
            "a.q",
            "a.p",
            "total",
            F.get("ends", F.col("a.i")).alias("low"),
            F.get("ends", F.col("a.i") + len(asked)).alias("high"),
        )
    )


def _interpolated(ranked: DataFrame, groups: list[str]) -> DataFrame:
    position = (F.col("total") - 1) * F.col("p")
    share = position - F.floor(position)
    ends = ranked.groupBy(*groups, "p", "total").agg(
        F.max(F.when(_holds(F.floor(position)), F.col("value"))).alias("low"),
        F.max(F.when(_holds(F.ceil(position)), F.col("value"))).alias("high"),
    )
    return ends.select(*groups, (F.col("low") * (1 - share) + F.col("high") * share).alias("quantile"))


def _whole(long: DataFrame, missed: DataFrame, brackets: DataFrame, groups: list[str]) -> DataFrame:
    """Quantiles of groups whose bracket missed, from all of their values."""
    affected = long.join(missed.select(*groups).distinct(), groups, "left_semi")
    wanted = brackets.join(missed.select(*groups, "q"), [*groups, "q"], "left_semi")
    ranked = cumulative_counts(affected, groups).drop("total").join(wanted, groups)
    return _interpolated(ranked, [*groups, "q"])


def _holds(index: Column) -> Column:
    return (F.col("below") <= index) & (index < F.col("below") + F.col("ties"))


def described(df: DataFrame, columns: Sequence[str], probabilities: dict[str, float], more: dict) -> DataFrame:
    """``variable, total``, the ``more`` aggregates and the quantiles of columns with values."""
    totals = stage(_totals(df, columns, [], more), "totals")
    found = _quantiles(df, columns, totals, probabilities, [], SMALL)
    return totals.where(F.col("total") > 0).join(found, "variable")


def group_median(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), p: float = 0.5, small: int | None = None
) -> DataFrame:
    """The median, or the quantile at ``p``, as column ``median``."""
    return exact_quantiles(df, columns, {"median": p}, keys, small)


def smallest(df: DataFrame, keys: Sequence[str], order: str, quota: DataFrame, tie: str) -> DataFrame:
    """The first ``quota`` rows of each group by the hash ``order`` (bigint), then ``tie``.

    ``quota`` holds ``keys`` and a column ``quota``. Counts per leading bits of
    the hash show which bucket the quota ends in; lower buckets are taken
    whole and only rows of that bucket are ranked.
    """
    keys = list(keys)
    bucket = F.shiftright(order, 48).alias("_bucket")
    along = Window.partitionBy(*keys).orderBy("_bucket")
    sizes = df.groupBy(*keys, bucket).agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(along))
    before = F.col("upto") - F.col("n")
    last = sizes.join(quota, keys).where((before < F.col("quota")) & (F.col("quota") <= F.col("upto")))
    last = stage(last.select(*keys, F.col("_bucket").alias("_last"), (F.col("quota") - before).alias("_left")), "last")
    marked = df.withColumn("_bucket", F.shiftright(order, 48)).join(last, keys)
    under = marked.where(F.col("_bucket") < F.col("_last")).select(*df.columns)
    edge = marked.where(F.col("_bucket") == F.col("_last")).select(*df.columns)
    return under.unionByName(_first(edge, keys, order, last.select(*keys, F.col("_left").alias("quota")), tie))


def _first(df: DataFrame, keys: list[str], order: str, quota: DataFrame, tie: str) -> DataFrame:
    """As ``smallest``, by ranking every distinct hash."""
    counts = cumulative_counts(df, keys, order).join(quota, keys)
    at = (F.col("below") < F.col("quota")) & (F.col("quota") <= F.col("below") + F.col("ties"))
    cut = counts.where(at).select(*keys, F.col(order).alias("_cut"), (F.col("quota") - F.col("below")).alias("_left"))
    marked = df.join(stage(cut, "cut"), keys)
    under = marked.where(F.col(order) < F.col("_cut"))
    at_cut = marked.where(F.col(order) == F.col("_cut"))
    # Copies of one row share its place: keep at most the quota per input slice, then overall.
    for part in ([*keys, "_slice"], keys):
        place = Window.partitionBy(*part).orderBy(tie)
        at_cut = (
            at_cut.withColumn("_slice", F.spark_partition_id())
            .withColumn("_rank", F.row_number().over(place))
            .where(F.col("_rank") <= F.col("_left"))
        )
    return under.select(*df.columns).unionByName(at_cut.select(*df.columns))
