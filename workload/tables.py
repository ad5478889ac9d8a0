"""Tract-shaped tables derived from the sales-style tables.

A customer is a tract, a nation a county and a region a state. Derived tables
are written once per Spark application and data folder, in the shared folder,
and then scanned like any stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtract.functions.scalars import geoid11_int, zero_pad
from fairtract.operators.drivers import nest_drivers, top_drivers_wide
from fairtract.operators.ranks import cumulative_counts, percent_rank, rank_columns
from fairtract.operators.select import complete_cases
from fairtract.sources import buckets
from fairtract.sources.writers import fips_table, write_tracts
from fairtract.staging import new_path, stage

MEASURES = [
    "CANCER", "RESP", "PM25", "OZONE", "DSLPM", "PTRAF", "LDPNT", "PNPL",
    "PRMP", "PTSDF", "UST", "PWDIS", "LOWINCPCT", "PEOPCOLORPCT",
]

# Coefficients of the linear contributions that stand in for a fitted model.
LINEAR = {
    "cancer": {"P_DSLPM": 0.5, "P_PTRAF": 0.3, "DEMOGIDX_2": -3.0},
    "resp": {"P_DSLPM": 0.2, "P_PTRAF": -0.4, "DEMOGIDX_2": 5.0},
}
LINEAR_FEATURES = list(LINEAR["cancer"])

_built: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(name: str):
    """Keep the derived table of one application and folder."""

    def wrap(build):
        def get(spark: SparkSession, sf_dir: str):
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _built:
                _built[key] = build(spark, sf_dir)
            return _built[key]

        return get

    return wrap


def _money(name: str) -> Column:
    """Whole hundredths: sums are exact in any order and stay in generated code, unlike wide decimals."""
    return F.floor(F.col(name) * 100 + 0.5)


def _when(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the sums that become indicators."""
    # An order has few lines, so summing them before the shuffle would take a sort of nearly all rows, on disk if
    # a task reads many. Shuffled by order first, each task sums a bounded part in memory.
    lines = (
        table(spark, sf_dir, "lineitem")
        .repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(
            F.count("*").alias("n_lines"),
            F.sum(_money("l_quantity")).alias("qty"),
            F.sum(_money("l_extendedprice")).alias("price"),
            F.max(_money("l_extendedprice")).alias("maxprice"),
            _when(F.col("l_returnflag") == "R", _money("l_extendedprice")).alias("rprice"),
            _when(F.col("l_returnflag") == "A", _money("l_extendedprice")).alias("aprice"),
            _when(F.col("l_linestatus") == "O", _money("l_quantity")).alias("oqty"),
            F.sum(_money("l_tax")).alias("tax"),
            F.sum(_money("l_discount")).alias("disc"),
        )
    )
    orders = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    per_customer = orders.groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"),
        F.sum(_money("o_totalprice")).alias("tot"),
        F.max("maxprice").alias("maxprice"),
        *[F.sum(c).alias(c) for c in ("n_lines", "qty", "price", "rprice", "aprice", "oqty", "tax", "disc")],
        _when(F.col("o_orderpriority") == "1-URGENT", _money("o_totalprice")).alias("urg"),
    )
    source = {
        "CANCER": "tot", "RESP": "price", "PM25": "n_lines", "OZONE": "qty", "DSLPM": "rprice",
        "PTRAF": "urg", "LDPNT": "aprice", "PNPL": "oqty", "PRMP": "maxprice", "PTSDF": "tax",
        "UST": "disc", "PWDIS": "n_orders",
    }
    key, nation = F.col("c_custkey"), F.col("n_nationkey")
    county = ((nation - nation % 5) / 5).cast("int").cast("string")
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == nation)
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(per_customer, F.col("o_custkey") == key, "left")
        .select(
            ((F.col("r_regionkey") + 1).cast("bigint") * 1000000000 + nation * 1000000 + key).alias("ID"),
            F.substring("r_name", 1, 2).alias("ST_ABBREV"),
            F.col("r_name").alias("STATE_NAME"),
            F.when(key % 50 != 0, F.concat(F.lit("County "), county)).alias("CNTY_NAME"),
            *[(F.col(c) / (1 if c.startswith("n_") else 100)).alias(name) for name, c in source.items()],
            F.col("c_acctbal").alias("LOWINCPCT"),
            (key % 101).cast("double").alias("PEOPCOLORPCT"),
            ((F.col("c_acctbal") + 1000) / 11000).alias("DEMOGIDX_2"),
        )
    )


CARRIED = ["ID", "ST_ABBREV", "STATE_NAME", "CNTY_NAME", "DEMOGIDX_2"]


def build_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = stage(raw(spark, sf_dir), "raw")
    row = ["ID", "ST_ABBREV"]
    ranked = rank_columns(base, row, MEASURES, 100 * percent_rank(), ["ST_ABBREV"])
    # Names and the raw index are joined back by id, not carried through every melted row.
    joined = base.select(*CARRIED).join(ranked, row)
    return joined.select(*CARRIED, *[F.col(c).alias(f"P_{c}") for c in MEASURES])


@_once("unit")
def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tract table: percentile of every measure within its state. Stored by state."""
    built = build_unit(spark, sf_dir)
    path = new_path(spark, "unit")
    write_tracts(built, path)
    return spark.read.schema(built.schema).parquet(path).select(*built.columns)


@_once("fips")
def fips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fips_table(unit(spark, sf_dir))


@_once("index")
def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second index that lacks the most vulnerable tracts; blanks around the id test the trim."""
    return _indexed(unit(spark, sf_dir).where((F.col("DEMOGIDX_2") < 0.9) & F.col("P_PTSDF").isNotNull()))


@_once("whole-index")
def whole_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second index that covers all tracts, for the models."""
    return _indexed(unit(spark, sf_dir).withColumn("P_PTSDF", F.coalesce("P_PTSDF", F.lit(-1.0))))


def _indexed(rows: DataFrame) -> DataFrame:
    # Ranked by P_PTSDF then ID, so that every pair is one row.
    pair = F.struct(F.col("P_PTSDF"), F.col("ID"))
    counts = cumulative_counts(rows.select(F.lit(0).alias("all"), pair.alias("pair")), ["all"], "pair")
    padded = zero_pad(F.col("pair.ID").cast("string"))
    ranked = counts.select(F.concat(F.lit(" "), padded, F.lit(" ")).alias("GEOID"), percent_rank().alias("RPL_EJI"))
    return stage(ranked, "index")


@_once("contributions")
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear contributions in wide form, ``shap_<outcome>_<feature>`` rounded to 7 decimals."""
    rows = complete_cases(unit(spark, sf_dir).select("ID", "ST_ABBREV", "CNTY_NAME", *LINEAR_FEATURES), LINEAR_FEATURES)
    means = stage(rows.groupBy("ST_ABBREV").agg(*[F.avg(c).alias(f"mean_{c}") for c in LINEAR_FEATURES]), "means")
    columns = {
        f"shap_{outcome}_{f}": F.round(F.lit(weight) * (F.col(f) - F.col(f"mean_{f}")), 7)
        for outcome, weights in LINEAR.items()
        for f, weight in weights.items()
    }
    return stage(rows.join(means, "ST_ABBREV").withColumns(columns).select("ID", "ST_ABBREV", "CNTY_NAME", *columns), "contributions")


def driver_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested top-three drivers per tract."""
    return nest_drivers(top_drivers_wide(contributions(spark, sf_dir), LINEAR_FEATURES))


def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle at a position per tract; where traffic is missing the id is no number."""
    tracts = unit(spark, sf_dir).select("ID", "P_PTRAF")
    lng = (F.col("ID") % 360 - 180).cast("double")
    lat = (F.col("ID") % 170 - 85).cast("double")
    ring = F.array(
        F.array(lng, lat), F.array(lng + 1, lat), F.array(lng + 1, lat + 1), F.array(lng, lat)
    )
    return tracts.select(
        F.when(F.col("P_PTRAF").isNull(), F.concat(F.lit("x"), F.col("ID").cast("string")))
        .otherwise(geoid11_int(F.col("ID")))
        .alias("GEOID"),
        F.struct(F.lit("Polygon").alias("type"), F.to_json(F.array(ring)).alias("coordinates")).alias("geometry"),
    )


#: Buckets of the stored join tables; a table of real size has as many as it needs for a bucket to fit a task.
BUCKETS = 16


def _bucketed(name: str, df: DataFrame, key: Column | None) -> DataFrame:
    path = new_path(df.sparkSession, name)
    return buckets.store(df, f"{name}_{path[-32:]}", BUCKETS, key, path)


@_once("bucketed-unit")
def bucketed_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed("tracts", unit(spark, sf_dir), buckets.by_number("ID"))


@_once("bucketed-boundaries")
def bucketed_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed("boundaries", boundaries(spark, sf_dir), buckets.by_number("GEOID"))


@_once("bucketed-index")
def bucketed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed("idx", index(spark, sf_dir), buckets.by_text("GEOID"))


@_once("bucketed-drivers")
def bucketed_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bucketed("drivers", driver_records(spark, sf_dir), None)


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries of four types: rings and lines hold all pairs of an embedding, points the first."""
    pair = lambda i: F.transform(F.slice("embedding", 2 * i + 1, 2), lambda x: x.cast("double"))
    line = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), pair)
    ring, point = F.array(line), F.element_at(line, 1)
    kind = F.col("vec_id") % 4
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.struct(
            F.when(kind == 0, "Point").when(kind == 1, "Polygon").when(kind == 2, "MultiPolygon").otherwise("LineString").alias("type"),
            F.when(kind == 0, F.to_json(point)).when(kind == 1, F.to_json(ring)).when(kind == 2, F.to_json(F.array(ring))).otherwise(F.to_json(line)).alias("coordinates"),
        ).alias("geometry"),
    )


def geoid(c: str = "ID") -> Column:
    return geoid11_int(F.col(c))


NO_INDEX = T.StructType([T.StructField("GEOID", T.StringType()), T.StructField("RPL_EJI", T.DoubleType())])
