"""Indicator tables, feature collections and keyed records as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtract import schema as names
from fairtract.functions.scalars import nan_to_null
from fairtract.sources import json_ranges, publish


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these paths exists: {', '.join(paths)}")


#: Where a row stands in its source: later rows compare greater.
POSITION = "_position"


def read_indicators(
    spark: SparkSession, path: str, format: str = "csv", infer: bool = True, position: bool = False
) -> DataFrame:
    """One row per tract. Known columns get their declared type, others the type that fits a CSV's values.

    ``infer=False`` spares the pass over the CSV that this needs and reads
    unknown columns as text. ``position`` adds the column ``_position`` with
    each row's place among the files, by which ``export`` and ``analyse`` let
    later rows of an id win.
    """
    if format == "csv":
        reader = spark.read.option("header", True).option("enforceSchema", False)
        header = spark.read.option("header", True).csv(path)
        if infer:
            header = reader.option("inferSchema", True).csv(path)
        known = set(names.known_columns())
        fields = [names.field(f.name) if f.name in known else f for f in header.schema.fields]
        raw = reader.schema(T.StructType(fields)).csv(path)
    else:
        raw = spark.read.format(format).load(path)
    if not position:
        return nan_to_null(raw)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    columns = raw.columns
    return nan_to_null(raw.select("*", place.alias(POSITION)).select(*columns, POSITION))


def optional_source(
    spark: SparkSession, path: str, schema: T.StructType, reader: Callable[[str], DataFrame]
) -> DataFrame:
    """The table at ``path``, or an empty one so that later left joins give NULL."""
    if path_exists(spark, path):
        return reader(path)
    return spark.createDataFrame([], schema)


def _feature_schema(columns: Iterable[str]) -> T.StructType:
    return T.StructType(
        [
            T.StructField("type", T.StringType()),
            T.StructField("properties", names.schema_for(list(columns))),
            T.StructField("geometry", names.GEOMETRY_SCHEMA),
        ]
    )


def _in_folders(spark: SparkSession, folder: str, published: bool, states: Sequence[str] | None) -> tuple[list[str], bool]:
    """The folders to read: all of one, or those that the last mark of a published one names."""
    found = publish.paths(spark, *folder.rstrip("/").rsplit("/", 1), states) if published else [folder]
    return found, not found


def read_features(
    spark: SparkSession,
    folder: str,
    states: Sequence[str] | None = None,
    columns: Sequence[str] = names.FEATURE_COLUMNS,
    published: bool = False,
) -> DataFrame:
    """Features written by ``write_features``, one row each; only asked-for states are scanned.

    ``published`` reads the states of this table that ``publish`` has put into the folder above.
    """
    schema = T.StructType([*_feature_schema(columns), T.StructField("state", T.StringType())])
    found, nothing = _in_folders(spark, folder, published, states)
    if nothing:
        return spark.createDataFrame([], schema)
    raw = spark.read.option("basePath", folder).schema(schema).json(found).select(*schema.names)
    return raw if states is None else raw.where(F.col("state").isin(list(states)))


def _packed(rows: DataFrame) -> DataFrame:
    """Coordinates are kept as the text of the file, which may be indented."""
    text = F.regexp_replace("geometry.coordinates", r"\s+", "")
    return rows.withColumn("geometry", F.col("geometry").withField("coordinates", text))


def read_feature_collections(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = names.FEATURE_COLUMNS,
    whole: bool = False,
    range_bytes: int = json_ranges.RANGE_BYTES,
) -> DataFrame:
    """Feature rows of ``FeatureCollection`` documents, one per line.

    ``whole`` reads classic files that hold one document over many lines, or in one long line: a
    task reads ranges of ``range_bytes``, one at a time, and the features that begin in them.
    """
    feature = _feature_schema(columns)
    if whole:
        raw = json_ranges.read_records(spark, path, "array", range_bytes)
        rows = raw.select(F.from_json("value", feature).alias("feature")).select("feature.*").where("type = 'Feature'")
    else:
        document = T.StructType([T.StructField("features", T.ArrayType(feature))])
        raw = spark.read.schema(document).json(path)
        rows = raw.select(F.explode("features").alias("feature")).select("feature.*")
    return _packed(rows)


def read_keyed_json(
    spark: SparkSession,
    path: str,
    value_schema: T.StructType,
    key: str = "geoid11",
    whole: bool = False,
    published: bool = False,
    range_bytes: int = json_ranges.RANGE_BYTES,
) -> DataFrame:
    """JSON objects keyed by id as rows ``key, value``, and the ``state`` of their folder where there is one.

    ``whole`` reads classic files that hold one object over many lines, or in one long line: a
    task reads ranges of ``range_bytes``, one at a time, and the members that begin in them. ``published``
    reads the states of this table that ``publish`` has put into the folder above.
    """
    if whole:
        raw = json_ranges.read_records(spark, path, "entries", range_bytes)
        state = F.nullif(F.regexp_extract("file", "/state=([^/]*)/", 1), F.lit(""))
        return raw.select(F.col("key").alias(key), F.from_json("value", value_schema).alias("value"), state.alias("state"))
    found, nothing = _in_folders(spark, path, published, None)
    if nothing:
        fields = [T.StructField(key, T.StringType()), T.StructField("value", value_schema), T.StructField("state", T.StringType())]
        return spark.createDataFrame([], T.StructType(fields))
    reader = spark.read.option("basePath", path) if published else spark.read
    text = reader.text(found).drop("version")
    parsed = F.from_json("value", T.MapType(T.StringType(), value_schema))
    return text.select(F.explode(parsed).alias(key, "value"), *[c for c in text.columns if c != "value"])
