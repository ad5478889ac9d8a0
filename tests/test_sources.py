import json

import pytest
from pyspark.sql import functions as F

from fairtract import schema as names
from fairtract.operators import joins, select
from fairtract.plans import jobs
from fairtract.sources import readers, writers


@pytest.fixture(scope="module")
def tracts(spark):
    """Three states, the first with most rows; ids repeat in no state."""
    df = spark.range(300).select(
        (F.lit(1_001_000_000) + F.col("id") + F.when(F.col("id") >= 250, 1_000_000_000).otherwise(0)).alias("ID"),
        F.when(F.col("id") < 250, "AL").when(F.col("id") < 295, "AK").otherwise(None).alias("ST_ABBREV"),
        F.when(F.col("id") % 9 != 0, F.concat(F.lit('The "'), (F.col("id") % 4).cast("string"), F.lit('" county'))).alias("CNTY_NAME"),
        (F.col("id") % 100).cast("double").alias("P_CANCER"),
        F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("id") / 3).alias("P_RESP"),
    )
    square = F.format_string("[[[%d,1.5],[2,3],[0,0]]]", F.col("ID") % 100)
    return df.withColumn("geometry", F.struct(F.lit("Polygon").alias("type"), square.alias("coordinates")))


def rows(df):
    return sorted(df.collect(), key=str)


def test_csv_keeps_types_and_turns_nan_into_null(spark, tracts, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_csv(tracts.drop("geometry"), path)
    found = readers.read_indicators(spark, path)
    assert dict(found.dtypes)["ID"] == "bigint" and dict(found.dtypes)["P_RESP"] == "double"
    assert found.where(F.col("P_RESP").isNull()).count() == 60
    assert found.agg(F.max("P_RESP")).head()[0] == pytest.approx(299 / 3)


def test_unknown_csv_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text('ID,EXTRA,CNTY_NAME\n1001020100,7,"Baldwin, AL"\n\n1001020200,,\n')
    plain = readers.read_indicators(spark, str(tmp_path / "x.csv"), infer=False)
    assert rows(plain) == [(1001020100, "7", "Baldwin, AL"), (1001020200, None, None)]
    assert dict(readers.read_indicators(spark, str(tmp_path / "x.csv")).dtypes)["EXTRA"] == "int"


def test_position_follows_the_files(spark, tmp_path):
    for name, values in (("a", range(50)), ("b", range(50, 90))):
        (tmp_path / f"{name}.csv").write_text("ID,EXTRA\n" + "".join(f"{v % 7},{v}\n" for v in values))
    found = readers.read_indicators(spark, str(tmp_path / "*.csv"), position=True)
    last = writers.last_by_key(found, "ID", readers.POSITION)
    assert sorted(r.EXTRA for r in last.collect()) == list(range(83, 90))


def test_first_existing_and_optional_source(spark, tmp_path):
    (tmp_path / "b.csv").write_text("GEOID\n1\n")
    assert readers.first_existing(spark, [str(tmp_path / "a"), str(tmp_path / "b.csv")]).endswith("b.csv")
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "a")])
    schema = names.schema_for(["GEOID"])
    read = lambda p: spark.read.schema(schema).csv(p, header=True)
    assert readers.optional_source(spark, str(tmp_path / "a"), schema, read).count() == 0
    assert readers.optional_source(spark, str(tmp_path / "b.csv"), schema, read).count() == 1


def test_features_round_trip_and_prune_states(spark, tracts, tmp_path):
    folder = str(tmp_path / "features")
    writers.write_features(tracts, folder)
    back = readers.read_features(spark, folder, ["AK"])
    assert back.count() == 45
    assert "PartitionFilters: [isnotnull(state" in back._jdf.queryExecution().toString()
    every = readers.read_features(spark, folder)
    assert every.count() == 295
    one = every.where(F.col("properties.ID") == 1_001_000_001).head()
    assert one.geometry.coordinates == "[[[1,1.5],[2,3],[0,0]]]" and one.properties.CNTY_NAME == 'The "1" county'
    line = json.loads(next(p for p in (tmp_path / "features" / "state=AK").iterdir() if p.suffix == ".txt").read_text().splitlines()[0])
    assert line["type"] == "Feature" and line["geometry"]["coordinates"][0][1] == [2, 3]
    assert set(line["properties"]) == {"ID", "ST_ABBREV", "CNTY_NAME", "P_CANCER", "P_RESP"}


def test_collections_are_split_but_whole(spark, tracts, tmp_path):
    copies = tracts.unionByName(tracts.where(F.col("ID") == 1_001_000_007).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("n"))
    folder = str(tmp_path / "collections")
    writers.write_feature_collections(copies, folder, per_document=50)
    lines = [r.value for r in spark.read.text(folder).where("state = 'AL'").collect()]
    sizes = [len(json.loads(line)["features"]) for line in lines]
    assert sum(sizes) == 450 and max(sizes) < 150
    assert readers.read_feature_collections(spark, folder).count() == 495


def test_classic_collection_file(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"ID": 5, "ST_ABBREV": "AL"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}
    (tmp_path / "AL.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, feature]}, indent=2))
    found = readers.read_feature_collections(spark, str(tmp_path / "AL.geojson"), whole=True)
    assert [(r.properties.ID, r.geometry.coordinates) for r in found.collect()] == [(5, "[1,2]")] * 2


def test_keyed_json_is_valid_and_whole(spark, tracts, tmp_path):
    keyed = tracts.drop("geometry").withColumn("geoid11", F.lpad(F.col("ID").cast("string"), 11, "0"))
    folder = str(tmp_path / "keyed")
    writers.write_keyed_json(keyed, folder, "geoid11", per_object=40)
    objects = [json.loads(r.value) for r in spark.read.text(folder).collect()]
    merged = {k: v for o in objects for k, v in o.items()}
    assert len(merged) == sum(map(len, objects)) == 295
    assert merged["01001000000"]["CNTY_NAME"] is None
    back = readers.read_keyed_json(spark, folder, names.schema_for(["ID", "CNTY_NAME"]))
    assert back.where(F.col("value.CNTY_NAME").isNull()).count() == 33


def test_pretty_printed_keyed_json(spark, tmp_path):
    (tmp_path / "AL.json").write_text(json.dumps({"01": {"ID": 1}, "02": {"ID": 2}}, indent=1))
    found = readers.read_keyed_json(spark, str(tmp_path / "AL.json"), names.schema_for(["ID"]), whole=True)
    assert sorted((r.geoid11, r.value.ID) for r in found.collect()) == [("01", 1), ("02", 2)]


def test_last_by_key(spark):
    df = spark.createDataFrame([(1, 10, "a"), (1, 12, "b"), (2, 5, None)], "ID long, pos long, v string")
    assert rows(writers.last_by_key(df, "ID", "pos")) == [(1, 12, "b"), (2, 5, None)]
    assert rows(writers.last_by_key(df.drop("pos"), "ID")) == [(1, "b"), (2, None)]


def test_require_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert writers.require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match="b, c"):
        writers.require_columns(df, ["a", "b", "c"])


def test_tract_lookup_reads_one_partition(spark, tracts, tmp_path):
    path = str(tmp_path / "tracts")
    writers.write_tracts(tracts.where("ST_ABBREV is not null"), path)
    stored = spark.read.parquet(path)
    fips = writers.fips_table(stored)
    assert rows(fips) == [("01", "AL"), ("02", "AK")]
    found = select.tract_by_id(stored, fips, "1001000003")
    assert [r.ID for r in found.collect()] == [1_001_000_003]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ST_ABBREV" in plan and "EqualTo(ID,1001000003)" in plan
    for unknown in ("99001000003", "1001999999", "", "1" * 30):
        assert select.tract_by_id(stored, fips, unknown).count() == 0
    ids = spark.createDataFrame([("tract 01001000003",), ("02001000260x",), ("77",)], "id string")
    assert sorted(r.ID for r in select.tracts_by_ids(stored, fips, ids).collect()) == [1_001_000_003, 2_001_000_260]


def test_geometry_join_fans_out_and_drops_bad_ids(spark):
    tracts = spark.createDataFrame([(1,), (2,)], "ID long")
    shapes = spark.createDataFrame([("0001", "a"), ("1", "b"), ("x2", "c"), (None, "d")], "GEOID string, geometry string")
    assert rows(joins.join_geometry(tracts, shapes)) == [(1, 1, "a"), (1, 1, "b")]


def test_index_join_trims_and_keeps_misses(spark):
    tracts = spark.createDataFrame([(1001020100, 1.0), (1001020200, 2.0)], "ID long, P_CANCER double")
    index = spark.createDataFrame([(" 01001020100 ", 0.5)], "GEOID string, RPL_EJI double")
    joined = joins.join_index(tracts, index)
    assert rows(joined) == [("01001020100", 1001020100, 1.0, 0.5), ("01001020200", 1001020200, 2.0, None)]
    assert joins.match_report(joined).head() == (1, 2)


def test_select_and_filters(spark, tracts):
    kept, missing = select.select_available(tracts, ["ID", "NOPE", "P_RESP"])
    assert kept.columns == ["ID", "P_RESP"] and missing == ["NOPE"]
    assert select.numeric_columns(tracts).columns == ["P_CANCER", "P_RESP"]
    assert select.prefix_columns(tracts).columns == ["P_CANCER", "P_RESP"]
    assert select.for_state(tracts).count() == 300 and select.for_state(tracts, "AK").count() == 45
    assert select.for_states(tracts, []).count() == 0 and select.for_states(tracts, [], ["AL"]).count() == 250
    assert select.drop_report(tracts, ["P_RESP"]).head() == (300, 240, 60)
    assert select.complete_cases(tracts, ["P_RESP"]).count() == 240
    assert [r[0] for r in select.distinct_states(tracts).collect()] == ["AK", "AL"]
    both = select.union_states([tracts.select("ID", "P_RESP"), tracts.select("ID")])
    assert both.count() == 600 and both.columns == ["ID", "P_RESP"]
    assert [r.ID for r in select.preview(tracts.select("ID"), 2, ["ID"]).collect()] == [1_001_000_000, 1_001_000_001]


def test_export_writes_every_product(spark, tracts, tmp_path):
    boundaries = tracts.select(F.col("ID").cast("string").alias("GEOID"), "geometry")
    folder = str(tmp_path / "out")
    report = jobs.export(tracts.drop("geometry"), boundaries, folder)
    assert rows(report) == [("AK", 45, 1), ("AL", 250, 1), (None, 295, 2)]
    manifest = spark.read.json(f"{folder}/manifest")
    assert [r.value for r in manifest.where("kind='state'").orderBy("position").collect()] == ["AK", "AL"]
    assert manifest.where("kind='indicator'").count() == 15
    records = readers.read_keyed_json(spark, f"{folder}/tract-data", names.schema_for(["ID", "P_RESP"]))
    assert records.count() == 295 and records.where(F.col("value.P_RESP").isNull()).count() == 59
    assert readers.read_features(spark, f"{folder}/features").count() == 295


def test_minimal_set_without_index(spark, tracts):
    assert jobs.analysis_minimal(tracts).columns == ["ID", "ST_ABBREV", "CNTY_NAME", "P_CANCER", "P_RESP"]
