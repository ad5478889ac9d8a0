"""Tracts that do better than their demographics predict, for every state at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtract.functions.scalars import geoid11
from fairtract.operators.moments import ols
from fairtract.operators.ranks import group_median
from fairtract.operators.select import complete_cases, distinct_states
from fairtract.schema import OUTCOME_COLUMNS, REGRESSION_PREDICTORS
from fairtract.staging import stage

STATE = "ST_ABBREV"
VULNERABILITY = "DEMOGIDX_2"
MIN_TRACTS = 10


def regression_columns(predictors: Sequence[str] = REGRESSION_PREDICTORS) -> list[str]:
    return [*OUTCOME_COLUMNS.values(), *predictors]


def ols_by_state(df: DataFrame, predictors: Sequence[str] = REGRESSION_PREDICTORS) -> DataFrame:
    """One row per state: size of the sample, and both models where it has at least ten tracts."""
    fits = ols(df, list(OUTCOME_COLUMNS.values()), predictors, [STATE])
    columns = []
    for name, column in OUTCOME_COLUMNS.items():
        of = F.col("outcome") == column
        columns += [
            F.max(F.when(of, F.col("intercept"))).alias(f"intercept_{name}"),
            F.max(F.when(of, F.col("coefficients"))).alias(f"coefficients_{name}"),
            F.max(F.when(of, F.col("r2"))).alias(f"r2_{name}"),
        ]
    wide = fits.groupBy(STATE).agg(F.max("n").alias("n_tracts"), *columns)
    all_states = distinct_states(df).join(wide, STATE, "left")
    enough = F.col("n_tracts") >= MIN_TRACTS
    return all_states.select(
        STATE,
        F.coalesce("n_tracts", F.lit(0)).alias("n_tracts"),
        *[F.when(enough, F.col(c)).alias(c) for c in wide.columns if c not in (STATE, "n_tracts")],
    )


def resilience(
    df: DataFrame,
    models: DataFrame | None = None,
    predictors: Sequence[str] = REGRESSION_PREDICTORS,
    threshold: float = 0.5,
) -> DataFrame:
    """Predictions, residuals and flags of every complete tract in states that have a model.

    Tracts at or above the ``threshold`` quantile of their state count as highly
    vulnerable: the median, or 0.75 for the stricter quartile.
    """
    predictors = list(predictors)
    rows = complete_cases(
        df.select(*dict.fromkeys(["ID", STATE, "CNTY_NAME", VULNERABILITY, *regression_columns(predictors)])),
        regression_columns(predictors),
    )
    if models is None:
        models = ols_by_state(df, predictors)
    medians = group_median(rows.select(STATE, VULNERABILITY), [VULNERABILITY], [STATE], threshold)
    fitted = stage(
        models.where(F.col("r2_cancer").isNotNull()).join(medians.select(STATE, "median"), STATE), "models"
    )
    joined = rows.join(fitted, STATE)
    predicted, residual = {}, {}
    for name, column in OUTCOME_COLUMNS.items():
        value = F.col(f"intercept_{name}")
        for i, x in enumerate(predictors):
            value = value + F.col(f"coefficients_{name}")[i] * F.col(x)
        predicted[f"{column}_pred"] = value
        residual[f"resid_{name}"] = F.col(column) - F.col(f"{column}_pred")
    vulnerable = F.col(VULNERABILITY) >= F.col("median")
    flags = {f"resilient_{name}": vulnerable & (F.col(f"resid_{name}") < 0) for name in OUTCOME_COLUMNS}
    return (
        joined.withColumns(predicted)
        .withColumns(residual)
        .withColumns({"high_vulnerability": vulnerable, **flags, "geoid11": geoid11(F.col("ID"))})
        .select(
            "ID", STATE, "CNTY_NAME", VULNERABILITY, *OUTCOME_COLUMNS.values(), *predicted, *residual,
            "high_vulnerability", *flags, "geoid11",
        )
    )


def resilience_summary(tracts: DataFrame, models: DataFrame) -> DataFrame:
    """Resilient tracts and fit per state; states without a model keep a row of NULLs."""
    counts = tracts.groupBy(STATE).agg(
        *[F.count_if(F.col(f"resilient_{name}")).alias(f"n_resilient_{name}") for name in OUTCOME_COLUMNS]
    )
    return models.join(counts, STATE, "left").select(
        STATE,
        "n_tracts",
        *[f"n_resilient_{name}" for name in OUTCOME_COLUMNS],
        *[F.round(f"r2_{name}", 4).alias(f"r2_{name}") for name in OUTCOME_COLUMNS],
    )


def rank_states(summary: DataFrame) -> DataFrame:
    """Average fit and share of resilient tracts of every state that has both models."""
    fitted = summary.where(F.col("r2_cancer").isNotNull() & F.col("r2_resp").isNotNull())
    shares = {
        f"pct_resilient_{name}": F.bround(F.try_divide(F.col(f"n_resilient_{name}"), "n_tracts") * 100, 1)
        for name in OUTCOME_COLUMNS
    }
    return fitted.withColumn("r2_avg", (F.col("r2_cancer") + F.col("r2_resp")) / 2).withColumns(shares)


def top_states(ranked: DataFrame, by: str, n: int = 15) -> DataFrame:
    return ranked.orderBy(F.desc(by), STATE).limit(n)
