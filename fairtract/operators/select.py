"""Projection, filters and look-ups over the tract table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtract import schema as names
from fairtract.functions.scalars import MISSING, format_key, format_value, geoid11, state_fips

STATE = "ST_ABBREV"
# Fixed value: the states shown where none is chosen.
DEFAULT_STATES = ["IN"]


def select_available(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The listed columns that exist, and the names of those that do not."""
    present = [c for c in columns if c in df.columns]
    return df.select(*present), [c for c in columns if c not in df.columns]


def numeric_names(df: DataFrame, exclude: Sequence[str] = names.ID_COLUMNS) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = names.ID_COLUMNS) -> DataFrame:
    return df.select(*numeric_names(df, exclude))


def prefix_names(df: DataFrame, prefix: str = "P_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def prefix_columns(df: DataFrame, prefix: str = "P_") -> DataFrame:
    return df.select(*prefix_names(df, prefix))


def for_state(df: DataFrame, state: str | None = None) -> DataFrame:
    return df.where(F.col(STATE) == state.upper()) if state else df


def for_states(df: DataFrame, states: Sequence[str], fallback: Sequence[str] = DEFAULT_STATES) -> DataFrame:
    """Membership filter; an empty selection means the default states."""
    return df.where(F.col(STATE).isin(list(states) or list(fallback)))


def complete_cases(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset is not None else None)


def present(df: DataFrame, columns: Sequence[str]) -> Column:
    """Whether a row has a value, and no NaN, in all columns."""
    usable = F.lit(True)
    for c in columns:
        usable = usable & F.col(c).isNotNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            usable = usable & ~F.isnan(c)
    return usable


def drop_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Row counts before and after ``complete_cases``, in one pass."""
    usable = present(df, list(subset) if subset is not None else df.columns)
    return df.agg(
        F.count("*").alias("n_before"),
        F.count_if(usable).alias("n_after"),
        F.count_if(~usable).alias("n_dropped"),
    )


def tract_by_id(df: DataFrame, fips: DataFrame, tract_id: str) -> DataFrame:
    """The record of one tract; an unknown state or tract gives no row.

    The state is looked up first, so that the scan of a table partitioned by
    state is pruned to one partition.
    """
    geoid = re.sub("[^0-9]", "", tract_id).rjust(11, "0")
    match = fips.where(F.col("fips") == geoid[:2]).select(STATE).head()
    if match is None or len(geoid) > 18:
        return df.limit(0)
    return df.where((F.col(STATE) == match[0]) & (F.col("ID") == int(geoid)))


def tracts_by_ids(df: DataFrame, fips: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Records of all ids in a table: id to FIPS to state to row."""
    geoid = geoid11(F.col(column))
    wanted = (
        ids.select(geoid.alias("_geoid"), geoid.try_cast("bigint").alias("ID"))
        .distinct()
        .join(fips, state_fips(F.col("_geoid")) == fips["fips"])
        .select("ID", STATE)
    )
    return df.join(wanted, [STATE, "ID"], "left_semi")


def drivers_for_tract(drivers: DataFrame, tract_id: str, state: str) -> DataFrame:
    """The attribution record of one tract, none if there is none.

    On a table written by ``write_tracts`` the state prunes partitions and the
    id is pushed down to the scan.
    """
    geoid = re.sub("[^0-9]", "", tract_id).rjust(11, "0")
    in_state = drivers.where(F.col(STATE) == state.upper())
    if "ID" not in drivers.columns:
        return in_state.where(F.col("geoid11") == geoid)
    return in_state.where(F.col("ID") == int(geoid)) if len(geoid) <= 18 else in_state.limit(0)


def tract_sections(
    df: DataFrame, key: str = "ID", sections: dict[str, Sequence[str]] = names.SECTIONS
) -> DataFrame:
    """Wide records as ``(key, section, position, field, title, value)``; absent columns are left out."""
    entries = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(position).alias("position"),
            F.lit(name).alias("field"),
            _shown(df, name).alias("value"),
        )
        for section, columns in sections.items()
        for position, name in enumerate(columns, 1)
        if name in df.columns
    ]
    return df.select(key, F.explode(F.array(*entries)).alias("e")).select(
        key,
        "e.section",
        "e.position",
        "e.field",
        format_key(F.col("e.field")).alias("title"),
        "e.value",
    )


def _shown(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return format_value(F.col(name))
    return F.coalesce(F.col(name).cast("string"), F.lit(MISSING))


def preview(df: DataFrame, n: int = 5, order: Sequence[str] | None = None) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def distinct_states(df: DataFrame) -> DataFrame:
    return df.select(STATE).where(F.col(STATE).isNotNull()).distinct().orderBy(STATE)


def union_states(frames: Sequence[DataFrame]) -> DataFrame:
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
