"""Feature contributions per tract: long, wide and nested forms, top drivers, importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtract.functions.scalars import geoid11
from fairtract.schema import OUTCOME_COLUMNS

STATE = "ST_ABBREV"
TOP = 3


def to_long(wide: DataFrame, features: Sequence[str], keys: Sequence[str] = ("ID", STATE, "CNTY_NAME")) -> DataFrame:
    """Columns ``shap_<outcome>_<feature>`` as rows ``keys, outcome, feature, shap``."""
    entries = [
        F.struct(
            F.lit(outcome).alias("outcome"), F.lit(f).alias("feature"), F.col(f"shap_{outcome}_{f}").alias("shap")
        )
        for outcome in OUTCOME_COLUMNS
        for f in features
        if f"shap_{outcome}_{f}" in wide.columns
    ]
    return wide.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def top_drivers(long: DataFrame, keys: Sequence[str], k: int = TOP) -> DataFrame:
    """The ``k`` features of largest absolute contribution per tract and outcome; ties by name."""
    order = Window.partitionBy(*keys, "outcome").orderBy(F.desc(F.abs("shap")), "feature")
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _strongest(outcome: str, features: Sequence[str], k: int) -> Column:
    entries = F.array(
        *[
            F.struct(
                (-F.abs(f"shap_{outcome}_{f}")).alias("order"),
                F.lit(f).alias("feature"),
                F.col(f"shap_{outcome}_{f}").alias("shap"),
            )
            for f in features
        ]
    )
    return F.slice(F.sort_array(entries), 1, k)


def top_drivers_wide(wide: DataFrame, features: Sequence[str], k: int = TOP) -> DataFrame:
    """Add ``top_<outcome>_<r>_feature`` and ``_shap`` columns; sorting stays inside each row."""
    lists, added = {}, {}
    for outcome in OUTCOME_COLUMNS:
        present = [f for f in features if f"shap_{outcome}_{f}" in wide.columns]
        if not present:
            continue
        lists[f"_strongest_{outcome}"] = _strongest(outcome, present, k)
        for r in range(1, k + 1):
            entry = F.get(f"_strongest_{outcome}", F.lit(r - 1))
            added[f"top_{outcome}_{r}_feature"], added[f"top_{outcome}_{r}_shap"] = entry["feature"], entry["shap"]
    return wide.withColumns(lists).withColumns(added).drop(*lists)


def top_columns(k: int = TOP) -> list[str]:
    return [f"top_{o}_{r}_{part}" for o in OUTCOME_COLUMNS for r in range(1, k + 1) for part in ("feature", "shap")]


def _contribution(c: Column) -> Column:
    value = c.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value)


def nest_drivers(wide: DataFrame, k: int = TOP) -> DataFrame:
    """Top columns as ``geoid11, ST_ABBREV, CNTY_NAME, cancer, resp``.

    A contribution that is no number counts as 0; rows without a state are left out.
    """
    lists = [
        F.array(
            *[
                F.struct(
                    F.col(f"top_{outcome}_{r}_feature").alias("feature"),
                    _contribution(F.col(f"top_{outcome}_{r}_shap")).alias("shap"),
                )
                for r in range(1, k + 1)
            ]
        ).alias(outcome)
        for outcome in OUTCOME_COLUMNS
    ]
    stated = wide.where(F.col(STATE).isNotNull() & (F.col(STATE) != ""))
    carried = [c for c in (STATE, "CNTY_NAME") if c in wide.columns]
    return stated.select(geoid11(F.col("ID")).alias("geoid11"), *carried, *lists)


def driver_importance(long: DataFrame) -> DataFrame:
    return long.groupBy("outcome", "feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def pivot_importance(importance: DataFrame) -> DataFrame:
    """One row per feature, one column per outcome."""
    return importance.groupBy("feature").pivot("outcome", list(OUTCOME_COLUMNS)).agg(F.first("mean_abs_shap"))
