"""Per-state exports, look-up tables and export checks.

Every sink is one job over all states. ``rebalance`` lets AQE split a state
that is too large for one task and join small ones, so a state that holds a
third of the rows is written by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairtract import schema as names
from fairtract.functions.scalars import geoid11_int, json_row, nan_to_null, state_fips
from fairtract.staging import stage

STATE = "ST_ABBREV"


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def write_tracts(df: DataFrame, path: str) -> None:
    """Parquet partitioned by state and sorted by id, for pruned look-ups."""
    rows = df.hint("rebalance", STATE).sortWithinPartitions(STATE, "ID")
    rows.write.partitionBy(STATE).parquet(path)


def features(df: DataFrame, columns: Sequence[str] = names.FEATURE_COLUMNS) -> DataFrame:
    """GeoJSON features with the kept properties that exist in ``df``."""
    kept = [c for c in columns if c in df.columns]
    return nan_to_null(df).select(
        F.lit("Feature").alias("type"),
        F.struct(*kept).alias("properties"),
        "geometry",
        F.col(STATE).alias("state"),
    )


def _feature_text(row: DataFrame) -> DataFrame:
    """Features as JSON text; coordinates go in as they are, not as a quoted string."""
    shape = F.format_string('{"type":"%s","coordinates":%s}', "geometry.type", "geometry.coordinates")
    geometry = F.when(F.col("geometry.coordinates").isNull(), "null").otherwise(shape)
    body = F.concat(
        F.lit('{"type":"Feature","properties":'),
        F.to_json("properties", {"ignoreNullFields": "false"}),
        F.lit(',"geometry":'),
        geometry,
        F.lit("}"),
    )
    return row.select("state", body.alias("value"))


def write_features(df: DataFrame, folder: str, columns: Sequence[str] = names.FEATURE_COLUMNS) -> None:
    """Line-delimited GeoJSON under ``state=XX`` folders; rows without a state are left out."""
    text = _feature_text(features(df.where(F.col(STATE).isNotNull()), columns))
    text.hint("rebalance", "state").write.partitionBy("state").text(folder)


def _pieces(df: DataFrame, spread: Column, per_piece: int) -> DataFrame:
    """Spread the rows of each state over pieces of about ``per_piece`` rows."""
    sizes = df.groupBy("state").agg(F.ceil(F.count("*") / F.lit(per_piece)).alias("pieces"))
    numbered = df.withColumn("spread", spread)
    return numbered.join(stage(sizes, "sizes"), "state").withColumn("piece", F.pmod("spread", "pieces"))


def write_feature_collections(
    df: DataFrame,
    folder: str,
    columns: Sequence[str] = names.FEATURE_COLUMNS,
    per_document: int = 2_000,
) -> None:
    """One or more ``FeatureCollection`` documents per state, one per line.

    The features of a state are dealt over documents of about ``per_document``,
    so no task ever holds a whole state; readers must not rely on one. Rows are dealt out by their position in
    a stored table: a hash would put all copies of one feature together.
    """
    text = stage(_feature_text(features(df.where(F.col(STATE).isNotNull()), columns)), "features")
    documents = (
        _pieces(text, F.monotonically_increasing_id(), per_document)
        .groupBy("state", "piece")
        .agg(F.array_join(F.collect_list("value"), ",").alias("body"))
        .select(
            "state",
            F.concat(F.lit('{"type":"FeatureCollection","features":['), "body", F.lit("]}")).alias("value"),
        )
    )
    documents.write.partitionBy("state").text(folder)


def _entries(df: DataFrame, key: str, value: Column | None, state: str) -> DataFrame:
    """Members of JSON objects as text: ``state, entry, entry_key``."""
    df = nan_to_null(df)
    body = value if value is not None else json_row(*[c for c in df.columns if c != key])
    quoted = F.to_json(F.array(F.col(key).cast("string")))
    return df.where(F.col(state).isNotNull() & F.col(key).isNotNull()).select(
        F.col(state).alias("state"),
        F.concat(quoted.substr(F.lit(2), F.length(quoted) - 2), F.lit(":"), body).alias("entry"),
        F.col(key).alias("entry_key"),
    )


def write_keyed_json(
    df: DataFrame,
    folder: str,
    key: str,
    value: Column | None = None,
    state: str = STATE,
    per_object: int = 5_000,
) -> None:
    """One or more JSON objects keyed by id per state under ``state=XX`` folders, one per line.

    Keys must be unique (see ``last_by_key``); the objects of a state, of about
    ``per_object`` keys, have disjoint keys.
    """
    entries = _entries(df, key, value, state)
    objects = (
        _pieces(entries, F.xxhash64("entry_key"), per_object)
        .groupBy("state", "piece")
        .agg(F.array_join(F.collect_list("entry"), ",").alias("body"))
        .select("state", F.concat(F.lit("{"), "body", F.lit("}")).alias("value"))
    )
    objects.write.partitionBy("state").text(folder)


def _write_documents(entries: DataFrame, head: str, tail: str, folder: str) -> None:
    """One document per state from ``state, value`` entries, one entry per line.

    A document is one file, so one task writes a state; it streams the sorted rows and holds none of them.
    """
    placed = stage(entries.select("state", "value", F.monotonically_increasing_id().alias("place")), "entries")
    first = placed.groupBy("state").agg(F.min("place").alias("first"))
    line = F.concat(F.when(F.col("place") == F.col("first"), "").otherwise(","), "value")
    lines = placed.join(stage(first, "first"), "state").select("state", "place", line.alias("value"))
    ends = placed.groupBy("state").agg(F.max("place").alias("last"))
    lines = lines.unionByName(first.select("state", (F.col("first") - 1).alias("place"), F.lit(head).alias("value")))
    lines = lines.unionByName(ends.select("state", (F.col("last") + 1).alias("place"), F.lit(tail).alias("value")))
    ordered = lines.repartition("state").sortWithinPartitions("state", "place")
    ordered.select("state", "value").write.partitionBy("state").text(folder)


def write_classic_collections(df: DataFrame, folder: str, columns: Sequence[str] = names.FEATURE_COLUMNS) -> None:
    """One ``FeatureCollection`` per state in one file, as other tools expect it; read it back in byte ranges."""
    text = _feature_text(features(df.where(F.col(STATE).isNotNull()), columns))
    _write_documents(text, '{"type":"FeatureCollection","features":[', "]}", folder)


def write_classic_keyed_json(df: DataFrame, folder: str, key: str, value: Column | None = None, state: str = STATE) -> None:
    """One JSON object keyed by id per state in one file. Keys must be unique (see ``last_by_key``)."""
    _write_documents(_entries(df, key, value, state).select("state", F.col("entry").alias("value")), "{", "}", folder)


def last_by_key(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The row with the greatest ``order`` for each key: later rows overwrite earlier ones.

    ``order`` is the position of a row in its source. Without one the whole
    row is compared, so that the choice does not depend on partitioning.
    """
    whole = F.struct(*df.columns)
    row = F.max_by(whole, F.col(order)) if order else F.max(whole)
    return df.groupBy(F.col(key).alias("_key")).agg(row.alias("row")).select("row.*")


def fips_table(df: DataFrame, order: str = STATE) -> DataFrame:
    """FIPS code and state; where two states share a code the last one by ``order`` wins.

    The table is stored, so that look-ups neither scan the tracts again nor
    shuffle by a code that a third of all tracts may share.
    """
    pairs = df.select(
        state_fips(geoid11_int(F.col("ID"))).alias("fips"), F.col(STATE), F.col(order).alias("_order")
    )
    last = F.max_by(STATE, "_order").alias(STATE)
    return stage(pairs.where(F.col("fips").isNotNull()).groupBy("fips").agg(last), "fips")


def manifest(df: DataFrame, indicators: dict[str, str] = names.INDICATOR_LABELS) -> DataFrame:
    """States in order, then indicators in menu order: ``kind, position, value, label``."""
    spark = df.sparkSession
    states = (
        df.select(F.col(STATE).alias("value"))
        .where(F.col(STATE).isNotNull())
        .groupBy("value")
        .agg(F.lit(None).cast("string").alias("label"))
    )
    # One row per state: the ordinal runs over the list of states, not over tracts.
    numbered = states.select(
        F.lit("state").alias("kind"),
        F.expr("row_number() over (order by value)").cast("int").alias("position"),
        "value",
        "label",
    )
    menu = spark.createDataFrame(
        [("indicator", i, value, label) for i, (value, label) in enumerate(indicators.items(), 1)],
        "kind string, position int, value string, label string",
    )
    return numbered.unionByName(menu)


def write_report(df: DataFrame) -> DataFrame:
    """Tracts per written state, and one total row with the number of states."""
    counts = df.where(F.col(STATE).isNotNull()).groupBy(STATE).agg(F.count("*").alias("tracts"))
    return counts.rollup(STATE).agg(
        F.sum("tracts").alias("tracts"), F.count("*").alias("states")
    )


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
