"""Group moments, standard scores, rank correlation and least squares.

All work on raw rows is one distributed aggregation per call; what remains is
one small row or a p by p block per group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtract.operators.rank_blocks import rank_moments
from fairtract.operators.select import complete_cases
from fairtract.staging import stage

# Up to this many columns the pairwise sums are plain aggregates in one pass.
NARROW = 8


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i:]]


def group_moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Centred cross-products of complete rows: ``keys, var1, var2, n, mean1, mean2, comoment``.

    Each unordered pair appears once, in column order.
    """
    rows = complete_cases(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]))
    if len(columns) <= NARROW:
        return _narrow_moments(rows, list(columns), list(keys))
    return _wide_moments(rows, list(columns), list(keys))


def _narrow_moments(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    pairs = _pairs(columns)
    wide = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"mean_{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(a, b).alias(f"cov_{i}") for i, (a, b) in enumerate(pairs)],
    )
    entries = [
        F.struct(
            F.lit(a).alias("var1"),
            F.lit(b).alias("var2"),
            F.col(f"mean_{columns.index(a)}").alias("mean1"),
            F.col(f"mean_{columns.index(b)}").alias("mean2"),
            (F.col(f"cov_{i}") * F.col("n")).alias("comoment"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return (
        wide.where(F.col("n") > 0)
        .select(*keys, "n", F.explode(F.array(*entries)).alias("e"))
        .select(*keys, "e.var1", "e.var2", "n", "e.mean1", "e.mean2", "e.comoment")
    )


def _wide_moments(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Two passes: means first, then one cross-product block per task and group, summed by Spark."""
    centred, means = centre(rows, columns, keys)
    pairs = _pairs(columns)
    left = np.array([columns.index(a) for a, _ in pairs])
    right = np.array([columns.index(b) for _, b in pairs])

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            groups = batch.groupby(keys, sort=False) if keys else [((), batch)]
            for key, part in groups:
                x = part[columns].to_numpy(dtype=float)
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums.get(key, 0) + x.T @ x
        for key, gram in sums.items():
            block = {name: [value] * len(pairs) for name, value in zip(keys, key)}
            yield pd.DataFrame({**block, "i": left, "j": right, "part": gram[left, right]})

    key_fields = [centred.schema[k] for k in keys]
    schema = T.StructType(
        [
            *key_fields,
            T.StructField("i", T.IntegerType()),
            T.StructField("j", T.IntegerType()),
            T.StructField("part", T.DoubleType()),
        ]
    )
    sums = centred.mapInPandas(blocks, schema).groupBy(*keys, "i", "j").agg(F.sum("part").alias("comoment"))
    names = F.array(*[F.lit(c) for c in columns])
    mean = F.array(*[F.col(f"mean_{i}") for i in range(len(columns))])
    joined = sums.join(means, keys) if keys else sums.withColumns(means)
    return joined.select(
        *keys,
        F.get(names, F.col("i")).alias("var1"),
        F.get(names, F.col("j")).alias("var2"),
        "n",
        F.get(mean, F.col("i")).alias("mean1"),
        F.get(mean, F.col("j")).alias("mean2"),
        "comoment",
    )


def _spread(rows: DataFrame, aggregates: dict, keys: list[str]):
    """Group statistics to attach to every row: a staged table, or literals for a single group."""
    stats = rows.groupBy(*keys).agg(*[c.alias(name) for name, c in aggregates.items()])
    if keys:
        return stage(stats, "stats")
    return {name: F.lit(value) for name, value in stats.head().asDict().items()}


def _attach(rows: DataFrame, stats, keys: list[str]) -> DataFrame:
    """Rows with the statistics of their group; a missing key is a group of its own."""
    if not keys:
        return rows.withColumns(stats)
    renamed = stats.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(renamed, same).drop(*[f"_{k}" for k in keys])


def centre(rows: DataFrame, columns: list[str], keys: list[str]):
    """Rows minus their group means, and the means with the group sizes."""
    means = {f"mean_{i}": F.avg(c) for i, c in enumerate(columns)}
    stats = _spread(rows, {"n": F.count("*"), **means}, keys)
    centred = _attach(rows, stats, keys).select(
        *keys, *[(F.col(c) - F.col(f"mean_{i}")).alias(c) for i, c in enumerate(columns)]
    )
    return centred, stats


def standardise(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Subtract the group mean and divide by the population deviation; a zero deviation divides by 1."""
    keys = list(keys)
    aggregates = {}
    for i, c in enumerate(columns):
        aggregates |= {f"_mean_{i}": F.avg(c), f"_std_{i}": F.stddev_pop(c)}
    attached = _attach(df, _spread(df, aggregates, keys), keys)
    scores = {}
    for i, c in enumerate(columns):
        std = F.col(f"_std_{i}")
        scores[c] = (F.col(c) - F.col(f"_mean_{i}")) / F.when(std == 0, 1.0).otherwise(std)
    return attached.withColumns(scores).select(*df.columns)


def correlations(moments: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of every ordered pair; NULL where a column is constant."""
    diagonal = moments.where(F.col("var1") == F.col("var2"))
    own = diagonal.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("var1", "comoment"))).alias("own")
    )
    if keys:
        joined = moments.join(own, list(keys))
    else:
        joined = moments.withColumn("own", F.create_map(*_literals(own)))
    product = F.col("own")[F.col("var1")] * F.col("own")[F.col("var2")]
    rho = F.when(
        product > 0,
        F.when(F.col("var1") == F.col("var2"), 1.0).otherwise(F.col("comoment") / F.sqrt(product)),
    )
    half = joined.select(*keys, "var1", "var2", "n", rho.alias("rho"))
    mirrored = half.where(F.col("var1") != F.col("var2")).select(
        *keys, F.col("var2").alias("var1"), F.col("var1").alias("var2"), "n", "rho"
    )
    return half.unionByName(mirrored)


def _literals(own: DataFrame) -> list:
    row = own.head()
    entries = row.own if row and row.own else {"": 0.0}
    return [F.lit(x) for pair in entries.items() for x in pair]


def spearman(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation matrix of complete cases, in long form; repeated rows all count."""
    rows = complete_cases(df.select(*keys, *columns), columns)
    return correlations(stage(rank_moments(rows, columns, keys), "moments"), keys)


def ols(
    df: DataFrame, outcomes: Sequence[str], predictors: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Least squares with intercept for each outcome: ``keys, outcome, n, intercept, coefficients, r2``.

    Solved from the centred cross-products; rank-deficient predictors get the
    solution of least norm. ``coefficients`` follow the order of ``predictors``.
    """
    keys, outcomes, predictors = list(keys), list(outcomes), list(predictors)
    columns = [*outcomes, *predictors]
    rows = complete_cases(df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]))

    def cov(a: str, b: str):
        # Same argument order both ways, so that each pair is summed once.
        return F.covar_pop(*sorted((a, b)))

    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(c) for c in columns]).alias("means"),
        F.array(*[cov(a, b) for a in columns for b in columns]).alias("cov"),
        F.array(*[F.max(c) == F.min(c) for c in outcomes]).alias("flat"),
    )
    return stats.where(F.col("n") > 0).mapInPandas(_solver(keys, outcomes, predictors), _ols_schema(stats, keys))


def _ols_schema(stats: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType(
        [
            *[stats.schema[k] for k in keys],
            T.StructField("outcome", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("intercept", T.DoubleType()),
            T.StructField("coefficients", T.ArrayType(T.DoubleType())),
            T.StructField("r2", T.DoubleType()),
        ]
    )


def _inverse(cov: np.ndarray) -> np.ndarray:
    """Inverse of a covariance matrix; where it has none, the pseudo-inverse, which gives least norm.

    Rank is judged on the correlation scale, so that units do not matter.
    """
    scale = np.sqrt(np.diag(cov))
    if (scale > 0).all():
        correlation = cov / np.outer(scale, scale)
        if np.linalg.eigvalsh(correlation)[0] > 1e-10:
            return np.linalg.inv(correlation) / np.outer(scale, scale)
    return np.linalg.pinv(cov, rcond=1e-12, hermitian=True)


def _solver(keys: list[str], outcomes: list[str], predictors: list[str]):
    q, p = len(outcomes), len(outcomes) + len(predictors)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for record in batch.to_dict("records"):
                means = np.asarray(record["means"], dtype=float)
                cov = np.asarray(record["cov"], dtype=float).reshape(p, p)
                inner = cov[q:, q:]
                inverse = _inverse(inner)
                for i, outcome in enumerate(outcomes):
                    beta = inverse @ cov[q:, i]
                    residual = cov[i, i] - 2 * beta @ cov[q:, i] + beta @ inner @ beta
                    if record["flat"][i]:
                        r2 = 1.0
                    else:
                        r2 = 1.0 - residual / cov[i, i]
                    out.append(
                        {
                            **{k: record[k] for k in keys},
                            "outcome": outcome,
                            "n": record["n"],
                            "intercept": means[i] - beta @ means[q:],
                            "coefficients": beta.tolist(),
                            "r2": r2,
                        }
                    )
            yield pd.DataFrame(out, columns=[*keys, "outcome", "n", "intercept", "coefficients", "r2"])

    return solve
