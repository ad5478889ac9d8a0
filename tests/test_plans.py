"""Plans hold at scale: no cross joins, pushed filters, results independent of partitioning."""

import re

import pytest
from pyspark.sql import functions as F

from fairtract.operators import ranks, rollup
from fairtract.staging import stage
from workload import tables
from workload.compare import rows_of
from workload.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
PLANNED = [
    "county_summary", "state_summary", "driver_frequency", "join_index", "join_geometry", "attach_state",
    "tracts_by_ids", "resilience", "histogram", "spearman", "spearman_all", "group_moments_wide", "standardise",
    "pca_by_state_all", "stratified_sample", "tract_context", "state_context", "result_blocks", "choropleth",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(QUERIES["group_median"](spark, SF_DIR))
    assert "P_CANCER" not in plan
    scan = re.search(r"ReadSchema: (\S+)", plan_of(QUERIES["for_state"](spark, SF_DIR)))
    assert scan.group(1) == "struct<ID:bigint,CNTY_NAME:string,P_CANCER:double>"


def test_state_filter_prunes_partitions(spark):
    assert re.search(r"PartitionFilters: \[[^\]]*ST_ABBREV#\d+ = AS", plan_of(QUERIES["for_state"](spark, SF_DIR)))


@pytest.mark.parametrize("name", ["join_geometry_bucketed", "join_index_bucketed", "attach_drivers_bucketed"])
def test_tables_in_buckets_join_without_a_shuffle(spark, name):
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        plan = plan_of(QUERIES[name](spark, SF_DIR))
    finally:
        spark.conf.set(setting, before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2


def test_top_results_are_limited_before_the_shuffle(spark):
    plan = plan_of(QUERIES["result_blocks"](spark, SF_DIR))
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("name", ["state_context_many_counties", "rank_counties", "nested_summary", "state_summary", "resilience_summary", "spearman", "describe", "driver_frequency_by_county", "stratified_sample"])
def test_partitioning_does_not_matter(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for partitions in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            df = QUERIES[name](spark, SF_DIR)
            found.append(rows_of(df.columns, df.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_county_means_have_equal_bits_in_any_order(spark):
    """Unrounded: the same doubles from 1, 4 and 16 partitions, however rows lie in them."""
    tracts = tables.unit(spark, SF_DIR).withColumn("CNTY_NAME", F.concat(F.lit("County "), (F.col("ID") % 4).cast("string")))
    found = []
    for partitions in (1, 4, 16):
        counties = rollup.county_summary(tracts.orderBy(F.xxhash64("ID", F.lit(partitions))).repartition(partitions))
        both = [counties, rollup.state_summary(counties.repartition(partitions)), rollup.rank_counties(counties).select("ST_ABBREV", "county", "risk", "rank")]
        found.append([sorted(map(tuple, df.collect())) for df in both])
    assert found[0] == found[1] == found[2]


def test_hot_value_is_dealt_over_slices(spark, monkeypatch):
    """A third of the rows share one value; they are ranked in several slices."""
    df = spark.range(60_000).select(
        F.col("id").alias("ID"),
        F.lit("AA").alias("ST_ABBREV"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("x"),
    )
    stored = {}
    monkeypatch.setattr(ranks, "stage", lambda table, name: stored.setdefault(name, stage(table, name)))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        ranked = ranks.rank_columns(df.repartition(8), ["ID", "ST_ABBREV"], ["x"], ranks.average_rank(), ["ST_ABBREV"])
        zeros = ranked.where("ID % 3 = 0").agg(F.min("x"), F.max("x"), F.count("*"))
        assert tuple(zeros.collect()[0]) == (10_000.5, 10_000.5, 20_000)
        sizes = [r["count"] for r in stored["slices"].groupBy("slice").count().collect()]
        assert len(sizes) == 16 and max(sizes) < 8_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bounds_parses_each_kind_once(spark):
    assert plan_of(QUERIES["bounds"](spark, SF_DIR)).split("== Initial Plan ==")[0].count("from_json") <= 6


def test_lookup_of_drivers_is_pruned_and_pushed_down(spark, tmp_path):
    from fairtract.operators import select
    from fairtract.sources.writers import write_tracts

    stored = spark.range(50).select((F.col("id") + 1_001_000_000).alias("ID"), F.lit("AA").alias("ST_ABBREV"), F.lit(1.0).alias("shap"))
    write_tracts(stored, str(tmp_path / "drivers"))
    found = select.drivers_for_tract(spark.read.parquet(str(tmp_path / "drivers")), "1001000007", "aa")
    assert found.count() == 1
    plan = plan_of(found)
    assert re.search(r"PartitionFilters: \[[^\]]*ST_ABBREV", plan) and "EqualTo(ID,1001000007)" in plan


def test_staging_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from fairtract.staging import scratch_dir

    context = SimpleNamespace(
        master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: None
    )
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=context)
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_dir(cluster)


def test_order_lines_are_summed_after_the_shuffle(spark):
    """An order has few lines: summing them before the shuffle takes memory for nearly all rows that a task reads."""
    lines = plan_of(tables.raw(spark, SF_DIR)).splitlines()
    shuffle = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(l_orderkey" in line)
    scan = next(i for i in range(shuffle, len(lines)) if "Scan parquet" in lines[i])
    assert not any("HashAggregate" in line for line in lines[shuffle:scan])
