"""Principal components of standardised columns, for one group or every state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtract.operators.moments import group_moments
from fairtract.operators.select import complete_cases, prefix_names, present
from fairtract.staging import stage

STATE = "ST_ABBREV"
# Components per state, and the smallest sample that gets any.
COMPONENTS = 20
MIN_TRACTS = 10
MIN_COLUMNS = 2


def _decompose(keys: list[str], columns: list[str], k: int):
    position = {c: i for i, c in enumerate(columns)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for record in batch.to_dict("records"):
                n, p = record["n"], len(columns)
                cross = np.zeros((p, p))
                for e in record["entries"]:
                    i, j = position[e["var1"]], position[e["var2"]]
                    cross[i, j] = cross[j, i] = e["comoment"]
                scale = np.sqrt(np.diag(cross))
                scale[scale == 0] = 1.0
                values, vectors = np.linalg.eigh(cross / np.outer(scale, scale))
                order = np.argsort(values)[::-1][: min(k, n, p)]
                total = values.clip(min=0).sum()
                for pc, which in enumerate(order, 1):
                    share = max(values[which], 0.0) / total if total > 0 else np.nan
                    yield pd.DataFrame(
                        {
                            **{name: [record[name]] * p for name in keys},
                            "n": n,
                            "pc": pc,
                            "var_explained": share,
                            "variable": columns,
                            "loading": vectors[:, which],
                        }
                    )

    return run


def pca(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), k: int = COMPONENTS) -> DataFrame:
    """Loadings and explained variance of complete cases: ``keys, n, pc, var_explained, variable, loading``.

    Components number min(k, rows, columns). The rows are reduced to one
    cross-product matrix per group; only that matrix reaches Python. The sign
    of a loading is arbitrary.
    """
    keys, columns = list(keys), list(columns)
    moments = group_moments(df, columns, keys)
    matrices = moments.groupBy(*keys).agg(
        F.max("n").alias("n"), F.collect_list(F.struct("var1", "var2", "comoment")).alias("entries")
    )
    matrices = matrices.where(F.size("entries") > 0)
    schema = T.StructType(
        [
            *[df.schema[key] for key in keys],
            T.StructField("n", T.LongType()),
            T.StructField("pc", T.IntegerType()),
            T.StructField("var_explained", T.DoubleType()),
            T.StructField("variable", T.StringType()),
            T.StructField("loading", T.DoubleType()),
        ]
    )
    return matrices.mapInPandas(_decompose(keys, columns, k), schema)


def top_loadings(loadings: DataFrame, keys: Sequence[str] = (), n: int = 10) -> DataFrame:
    """Variables of largest absolute loading per component as columns ``top1_var`` and so on."""
    keys = list(keys)
    order = Window.partitionBy(*keys, "pc").orderBy(F.desc(F.abs("loading")), "variable")
    ranked = loadings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return ranked.groupBy(*keys, "n", "pc", "var_explained").agg(
        *[F.max(F.when(F.col("rank") == i, F.col("variable"))).alias(f"top{i}_var") for i in range(1, n + 1)]
    )


def cumulative_variance(components: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Running sum of explained variance; ``components`` has one row per component."""
    along = Window.partitionBy(*keys).orderBy("pc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return components.withColumn("cumulative", F.sum("var_explained").over(along))


def pad_components(components: DataFrame, states: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Exactly ``k`` rows per state. ``states`` holds ``ST_ABBREV, n_tracts`` of every state."""
    grid = states.withColumn("pc", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return grid.join(components.drop("n"), [STATE, "pc"], "left")


def pca_by_state(df: DataFrame, columns: Sequence[str] | None = None, k: int = COMPONENTS) -> DataFrame:
    """One row per state and component with the top ten variables, all states in one plan.

    States with too few complete tracts keep their rows, with NULLs.
    """
    columns = list(columns) if columns is not None else prefix_names(df)
    rows = df.select(STATE, *columns).where(F.col(STATE).isNotNull())
    complete = complete_cases(rows, columns)
    # The list of states and the sizes of their samples in one pass.
    usable = F.count_if(present(rows, columns)) if columns else F.count("*")
    states = stage(rows.groupBy(STATE).agg(usable.alias("n_tracts")), "states")
    if len(columns) < MIN_COLUMNS:
        enough = states.where(F.lit(False))
    else:
        enough = states.where(F.col("n_tracts") >= MIN_TRACTS)
    usable = complete.join(enough.select(STATE), STATE, "left_semi")
    components = top_loadings(pca(usable, columns, [STATE], k), [STATE])
    rounded = components.withColumn("var_explained", F.round("var_explained", 6))
    return (
        pad_components(rounded, states, k)
        .withColumnRenamed("pc", "PC")
        .select(STATE, "n_tracts", "PC", "var_explained", *[f"top{i}_var" for i in range(1, 11)])
    )
