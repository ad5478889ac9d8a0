"""Mixing sources to target weights by capped water-filling, with native functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtract.llm.storage import stage
from fairtract.llm.words import WORD_PATTERN

WEIGHTS = (5.0, 2.0, 1.0)
#: Hex digits of a document's seeded digest that make its bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target``.

    Weights are dealt to the sources in code-point order, null last, again and
    again. A source above ``max_epochs`` times its size is clamped there and the
    excess goes to the others by weight, until none is above. The level at
    which that ends is found in one pass: in order of cap per weight, the first
    clamped sources are those whose cap lies under the level that the rest
    would get. The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy("level_of_cap", F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    levels = (
        sizes.withColumn("weight", F.get(dealt, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("level_of_cap", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn(
            "level",
            (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest),
        )
        .withColumn("clamped", F.col("level") >= F.col("level_of_cap"))
        # Clamped sources come first; the level of the first free one holds for all free ones.
        .withColumn("final", F.max(F.when(~F.col("clamped"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.0,
    max_epochs: float = 3.0,
    seed: int = 42,
    rows: bool = True,
) -> DataFrame:
    """How often each document enters a mix of ``docs(doc_id, source, text)``.

    Every document enters ``floor(target / source_size)`` times; for the
    fraction that is left, documents enter once more in the order of a seeded
    digest until the source's words come as near to its target as the last
    document allows. The order is exact without a sort of a whole source:
    words are summed by bucket of the digest first, and only the bucket in
    which the fraction ends is ranked by document.

    Returns one row per input row: ``doc_id, source, size, source_size, target,
    copies, taken, row``, the last a struct of all its columns. Without ``rows`` it is left out, and sizes and digests
    are stored once instead of being taken from the texts again. A null text has size 0 and is taken as often as its source
    is; a null source is a source of its own; a null doc_id counts as its own
    text. Equal rows share their digest and are told apart by position in it.
    An empty table gives an empty one. Other columns are only passed on.
    """
    number = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce("text", F.lit(""))))
    digest = F.md5(F.concat(F.lit(f"{seed} "), number).cast("binary"))
    whole_row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("digest"), *whole_row)
    sized = sized.withColumn("bucket", F.conv(F.substring("digest", 1, BUCKET_DIGITS), 16, 10).cast("int"))
    if not rows:
        sized = stage(sized, "sizes")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    targets = targets.withColumn("whole", whole.cast("long")).withColumn(
        "left", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    )
    # Of each source the first bucket that the fraction does not take whole: those before it enter, those after it do not.
    in_source = Window.partitionBy("b.source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        buckets.alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .withColumn("before", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0)))
        .groupBy("b.source", "source_size", "target", "whole", "left")
        .agg(F.min(F.when(F.col("before") + F.col("bucket_size") > F.col("left"), F.struct(F.col("bucket").alias("at"), "before"))).alias("last"))
    )
    # One row per source. Stored, its size is known, and documents need no shuffle to meet a small table.
    plan = stage(last.select("source", "source_size", "target", "whole", "left", "last.at", "last.before"), "mix-plan")
    kept = ["row"] if rows else []
    placed = sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).drop(F.col("p.source"))
    inside = F.col("at").isNull() | (F.col("bucket") < F.col("at"))
    ends_here = (F.col("bucket") == F.col("at")) & (F.col("before") < F.col("left"))
    clear = placed.where(inside | ~ends_here).withColumn("more", inside.cast("long"))
    ordered = Window.partitionBy("source").orderBy("digest", F.col("doc_id").asc_nulls_last(), "size")
    upto = F.col("before") + F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    # The last document enters if more than half of it is wanted.
    edge = placed.where(~inside & ends_here).withColumn("more", (upto - F.col("size") / 2.0 < F.col("left")).cast("long"))
    copies = F.col("whole") + F.when(F.col("source_size") > 0, F.col("more")).otherwise(F.lit(0))
    return reduce(DataFrame.unionByName, [clear, edge]).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *kept,
    )


def drawn(mixed: DataFrame) -> DataFrame:
    """The rows of a mix, each as often as it enters."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
