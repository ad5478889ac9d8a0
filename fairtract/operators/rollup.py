"""County and state roll-ups, driver counts and county ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fairtract.functions.scalars import county_or_unknown
from fairtract.functions.sums import exact_mean, exact_sum
from fairtract.schema import OUTCOME_COLUMNS, ROLLUP_DEMOGRAPHICS, ROLLUP_ENVIRONMENT

STATE = "ST_ABBREV"
MEASURES = [*ROLLUP_ENVIRONMENT, *ROLLUP_DEMOGRAPHICS]


def county_summary(df: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Tracts and means per county. Missing values are skipped; a county with none counts as 0.

    Means are the same to the last bit in any order of the rows, as ranks and texts build on them.
    """
    counties = df.select(STATE, county_or_unknown(F.col("CNTY_NAME")).alias("county"), *measures)
    return counties.groupBy(STATE, "county").agg(
        F.count("*").alias("tract_count"),
        *[F.coalesce(exact_mean(F.col(c)), F.lit(0.0)).alias(c) for c in measures],
    )


def state_summary(counties: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Means of the county means weighted by tracts, which differ from plain tract means
    wherever a county has missing values."""
    weighted = [
        F.try_divide(exact_sum(F.col(c) * F.col("tract_count")), F.sum("tract_count")).alias(c)
        for c in measures
    ]
    return counties.groupBy(STATE).agg(
        F.sum("tract_count").alias("tract_count"), F.count("*").alias("county_count"), *weighted
    )


def nested_summary(counties: DataFrame, counts: DataFrame) -> DataFrame:
    """States with means as two maps, their top drivers, and the list of their counties, highest risk first.

    ``counties`` is the county summary and ``counts`` the driver counts by
    state and county; a state's list has one entry per county.
    """
    by_county = [STATE, "county"]
    states = with_maps(state_summary(counties)).join(driver_lists(driver_frequency(counts, [STATE], 5), [STATE]), STATE, "left")
    listed = with_maps(rank_counties(counties)).join(driver_lists(driver_frequency(counts, by_county, 3), by_county), by_county, "left")
    fields = [c for c in listed.columns if c not in (STATE, "risk")]
    entry = F.struct("rank", *[c for c in fields if c != "rank"])
    # Entries hold maps, which have no order of their own, so ranks are compared.
    in_order = F.array_sort(F.collect_list(entry), lambda a, b: a["rank"] - b["rank"])
    return states.join(listed.groupBy(STATE).agg(in_order.alias("counties")), STATE)


def with_maps(summary: DataFrame) -> DataFrame:
    """The means of a summary as two maps, with the outcomes also on top level."""

    def as_map(columns: Sequence[str]):
        return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])

    rest = [c for c in summary.columns if c not in MEASURES]
    return summary.select(
        *rest,
        F.col("P_CANCER").alias("avg_cancer"),
        F.col("P_RESP").alias("avg_resp"),
        as_map(ROLLUP_ENVIRONMENT).alias("avg_env"),
        as_map(ROLLUP_DEMOGRAPHICS).alias("avg_demo"),
    )


def driver_counts(drivers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tracts per group in which a feature raises risk: ``keys, outcome, feature, count``.

    One pass for all outcomes; lists are cut down to names inside each row.
    """

    def raising(outcome: str):
        positive = F.filter(outcome, lambda d: d["shap"] > 0)
        named = F.transform(positive, lambda d: F.struct(F.lit(outcome).alias("outcome"), d["feature"].alias("feature")))
        return F.coalesce(named, F.array().cast("array<struct<outcome:string,feature:string>>"))

    found = F.explode(F.concat(*[raising(outcome) for outcome in OUTCOME_COLUMNS])).alias("d")
    return drivers.select(*keys, found).groupBy(*keys, "d.outcome", "d.feature").agg(F.count("*").alias("count"))


def driver_frequency(counts: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` most frequent features per group and outcome; ties by name.

    ``counts`` may be finer than ``keys``: state lists come from county counts.
    """
    keys = list(keys)
    totals = counts.groupBy(*keys, "outcome", "feature").agg(F.sum("count").alias("count"))
    order = Window.partitionBy(*keys, "outcome").orderBy(F.desc("count"), "feature")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def driver_lists(frequency: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranked counts folded into one array per group and outcome: ``top_cancer``, ``top_resp``."""

    def folded(outcome: str):
        entries = F.collect_list(F.when(F.col("outcome") == outcome, F.struct("rank", "feature", "count")))
        named = lambda e: F.struct(e["feature"].alias("feature"), e["count"].alias("count"))
        return F.transform(F.array_sort(entries), named).alias(f"top_{outcome}")

    return frequency.groupBy(*keys).agg(*[folded(outcome) for outcome in OUTCOME_COLUMNS])


def rank_counties(counties: DataFrame) -> DataFrame:
    """Counties of a state by mean of both outcomes, highest first; ties by name.

    Means do not depend on the order of rows, and risks are compared to nine decimals:
    what lies below is left by the last bits of the tracts' values, in which counties that
    are equal on paper may differ. The input has one row per county, so a state's group is
    its list of counties.
    """
    risk = (F.col("P_CANCER") + F.col("P_RESP")) / 2
    order = Window.partitionBy(STATE).orderBy(F.round("risk", 9).desc(), "county")
    return counties.withColumn("risk", risk).withColumn("rank", F.row_number().over(order))


def split_top(ranked: DataFrame, n: int = 15) -> DataFrame:
    return ranked.withColumn("detailed", F.col("rank") <= n)
