"""Documents read in byte ranges of any size against a plain parser; published exports."""

import json
import pickle
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtract import schema as names
from fairtract.sources import json_ranges, publish, readers, writers

TRICKY = ['plain', 'a "quoted" word', 'back\\slash', 'ends with \\', '{"type":"Feature"}', '}],{"x":[', "é日本\n\t", '\\"', '"', '\\\\"', ""]


def ranges_of(path, size):
    """As ``read_records`` does, without Spark."""
    total = path.stat().st_size
    parts = [json_ranges.Range(str(path), a, min(a + size, total)) for a in range(0, total, size)]
    state = (False, 0, 0)
    for part in parts:
        part.in_string, part.depth, part.last = state
        _, _, quotes, down0, last0, down1, last1 = next(json_ranges._Scan([]).read(part))
        down, last = (down1, last1) if part.in_string else (down0, last0)
        state = (part.in_string ^ bool(quotes), part.depth + down, last or part.last)
    return parts


def records(path, size, kind):
    reader = json_ranges._Records([], kind)
    return [row for part in ranges_of(path, size) for batch in reader.read(part) for row in batch.to_pylist()]


def feature(rng, i):
    return {"type": "Feature", "properties": {"ID": i, "note": rng.choice(TRICKY), "list": [{"a": [1, {"b": "]"}]}]}, "geometry": None}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1_000, 10**9])
def test_every_feature_once_whatever_the_ranges(tmp_path, size, indent):
    rng = random.Random(size)
    features = [feature(rng, i) for i in range(40)]
    document = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "bbox": [1, [2]], "features": features, "after": {"k": [1]}}
    path = tmp_path / "AL.json"
    path.write_text(json.dumps(document, indent=indent, ensure_ascii=False) + "\n" + json.dumps({"features": features[:3]}))
    assert [json.loads(r["value"]) for r in records(path, size, "array")] == features + features[:3]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("size", [1, 2, 5, 50, 10**9])
def test_every_member_once_whatever_the_ranges(tmp_path, size, indent):
    rng = random.Random(size)
    members = {rng.choice(TRICKY) + str(i): rng.choice([feature(rng, i), [1, "a,b"], "x", 5, None, {}]) for i in range(40)}
    path = tmp_path / "AL.json"
    path.write_text(json.dumps(members, indent=indent, ensure_ascii=False))
    assert [(r["key"], json.loads(r["value"])) for r in records(path, size, "entries")] == list(members.items())
    path.write_text("{}")
    assert records(path, size, "entries") == []


def test_records_longer_than_a_tail_are_finished(tmp_path, monkeypatch):
    monkeypatch.setattr(json_ranges, "_TAIL", 8)
    features = [{"type": "Feature", "text": "x" * 500}, {"type": "Feature", "text": "y"}]
    path = tmp_path / "AL.json"
    path.write_text(json.dumps({"features": features}))
    assert [json.loads(r["value"]) for r in records(path, 30, "array")] == features


def test_one_document_is_read_by_several_tasks(spark, tmp_path):
    rows = spark.range(2_000).select(
        F.col("id").alias("ID"), F.lit("AL").alias("ST_ABBREV"), F.concat(F.lit('C "'), "id").alias("CNTY_NAME"),
        F.struct(F.lit("Point").alias("type"), F.format_string("[%d,2]", "id").alias("coordinates")).alias("geometry"),
    )
    folder = str(tmp_path / "classic")
    writers.write_classic_collections(rows, folder)
    files = [p for p in (tmp_path / "classic" / "state=AL").iterdir() if p.suffix == ".txt"]
    assert len(files) == 1 and len(json.loads(files[0].read_text())["features"]) == 2_000
    found = readers.read_feature_collections(spark, folder, whole=True, range_bytes=30_000)
    sizes = found.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) >= 4 and max(sizes) < 600 and sum(sizes) == 2_000
    assert sorted((r.properties.ID, r.geometry.coordinates) for r in found.collect()) == [(i, f"[{i},2]") for i in range(2_000)]

    keyed = rows.drop("geometry").withColumn("geoid11", F.lpad(F.col("ID").cast("string"), 11, "0"))
    writers.write_classic_keyed_json(keyed, str(tmp_path / "keyed"), "geoid11")
    back = readers.read_keyed_json(spark, str(tmp_path / "keyed"), names.schema_for(["ID"]), whole=True, range_bytes=30_000)
    assert back.rdd.getNumPartitions() >= 4
    assert sorted((r.geoid11, r.value.ID, r.state) for r in back.collect()) == [(f"{i:011d}", i, "AL") for i in range(2_000)]


def exported(rows, path):
    rows.write.partitionBy("state").text(path)


def states(spark, folder):
    found = publish.paths(spark, folder, "t")
    return sorted(map(tuple, spark.read.option("basePath", f"{folder}/t").text(found).select("state", "value").collect())) if found else []


def test_published_states_are_replaced_together(spark, tmp_path):
    folder = str(tmp_path)
    table = lambda *rows: spark.createDataFrame(rows, "state string, value string")
    write = lambda df: {"t": lambda path: exported(df, path)}
    assert states(spark, folder) == []
    publish.publish(spark, folder, write(table(("AL", "1"), ("AK", "1"), ("AZ", "1"))))
    publish.publish(spark, folder, write(table(("AL", "2"))), ["AL", "AZ"])
    assert states(spark, folder) == [("AK", "1"), ("AL", "2")]

    def breaks(path):
        exported(table(("AK", "3")), path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        publish.publish(spark, folder, {"t": breaks})
    assert states(spark, folder) == [("AK", "1"), ("AL", "2")]
    # An export that another one overtakes is refused.
    overtaken = lambda path: (exported(table(("AK", "4")), path), publish.publish(spark, folder, write(table(("AK", "5")))))
    with pytest.raises(publish.ConcurrentExport):
        publish.publish(spark, folder, {"t": overtaken})
    assert states(spark, folder) == [("AK", "5"), ("AL", "2")]
    assert publish.clean(spark, folder) == 3 and states(spark, folder) == [("AK", "5"), ("AL", "2")]
    schema = T.StructType([T.StructField("x", T.LongType())])
    assert readers.read_keyed_json(spark, f"{folder}/none", schema, published=True).count() == 0


@pytest.mark.parametrize("step", [1, 7, 64, 10_000])
@pytest.mark.parametrize("span", [70, 1_000, 10**6])
def test_spans_of_ranges_give_every_record_once(tmp_path, step, span):
    rng = random.Random(step + span)
    features = [feature(rng, i) for i in range(30)]
    members = {rng.choice(TRICKY) + str(i): rng.choice([feature(rng, i), [1, "a,b"], "x", None]) for i in range(30)}
    for kind, document, want in (("array", {"features": features}, features), ("entries", members, list(members.items()))):
        path = tmp_path / f"{kind}.json"
        path.write_text(json.dumps(document, ensure_ascii=False))
        plain = ranges_of(path, span)
        for part in plain:
            whole = list(json_ranges._Scan([]).read(part))
            part.step = step
            assert list(json_ranges._Scan([]).read(part)) == whole
        rows = [row for part in plain for batch in json_ranges._Records([], kind).read(part) for row in batch.to_pylist()]
        assert [json.loads(r["value"]) if kind == "array" else (r["key"], json.loads(r["value"])) for r in rows] == want


def test_tasks_follow_the_cores_and_not_the_ranges(spark, tmp_path):
    document = {"features": [{"type": "Feature", "properties": {"ID": i}, "geometry": None} for i in range(5_000)]}
    (tmp_path / "AL.json").write_text(json.dumps(document))
    raw = json_ranges.read_records(spark, str(tmp_path), "array", 200)
    cores = spark.sparkContext.defaultParallelism
    assert raw.count() == 5_000 and cores <= raw.rdd.getNumPartitions() <= 2 * json_ranges.SPANS_PER_CORE * cores
    assert json_ranges._span(10**13, 32_768, 8) == json_ranges.SPAN_BYTES and json_ranges._span(10, 50, 8) == 50
    parts = [json_ranges.Range("a", i, i + 1) for i in range(10_000)]
    assert len(pickle.dumps(json_ranges._Records(parts, "array"))) < 1_000  # tasks do not get all ranges
