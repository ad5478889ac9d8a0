"""Every query against its SQL, and the pipeline against its stages in plain Python."""

import importlib

import pytest

import corpus_pipeline
from fairtract.llm.queries import ORACLES, QUERIES
from tests.check import connect
from tests.llm.test_near import plain as groups
from tests.llm.test_passages import plain as cut
from workload.compare import difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR).sql(ORACLES[name])) is None


def test_all_operators_are_registered():
    entry = importlib.import_module("__spark_entry__").queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) <= set(entry) and "pipeline" in entry


def test_native_operators_run_no_python(spark):
    for name in ("op6_source_mix", "op8_url_rules"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stages_equal_plain_versions(spark):
    from fairtract.llm import quality
    from tests.llm.test_python_operators import judged

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)

    kept = corpus_pipeline.storage.stage(stage["quality rules"](spark, docs, SF_DIR), "t")
    bands = quality.fit_bands(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    verdicts = {r.doc_id: r for r in quality.judge(docs, bands).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, v in verdicts.items() if v.kept}
    assert all(verdicts[i].base_failed == judged(r.text)[5] for i, r in rows.items())

    single = corpus_pipeline.storage.stage(stage["near duplicates"](spark, kept, SF_DIR), "t")
    ids = {r.doc_id for r in kept.collect()}
    want = {i for i, _, c, k in groups([(i, rows[i].text) for i in ids], 5, 80) if k}
    assert {r.doc_id for r in single.collect()} == want and single.count() == len(want)

    rest = corpus_pipeline.storage.stage(stage["substring dedup"](spark, single, SF_DIR), "t")
    by_id = {r.doc_id: r for r in rest.collect()}
    for i, _, gone, text in cut([(i, rows[i].text) for i in want], 20):
        assert by_id[i].text == (text if gone else rows[i].text)
        assert by_id[i].n_chars == (len(text) if gone else rows[i].n_chars) and by_id[i].source == rows[i].source

    mixed = corpus_pipeline.storage.stage(stage["source mix"](spark, rest, SF_DIR), "t")
    for out in (kept, single, rest, mixed):
        assert out.columns == columns
    last = stage["byte-pair encoding"](spark, mixed, SF_DIR)
    assert last.count() == mixed.count() and all(len(r.ids) == r.n_tokens for r in last.collect())
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(str, whole.drop("ids").collect())) == sorted(map(str, last.drop("ids").collect()))


def test_stages_take_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, `_` int"
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(400))
    odd = [(1, None, None, None, None, "k", 1), (None, long_text, "en", "a", 3, "k", 1), (None, None, None, None, None, None, None)]
    odd += [(2, long_text, "en", "a", 9, None, 2), (2, long_text, "en", "a", 9, None, 2), (3, long_text + " end", "en", "b", 9, None, 2)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for _, function in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.storage.stage(function(spark, docs, SF_DIR), "t")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "_"]
        ids = [r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()]
        assert set(ids) <= {None, 2} and bool(ids) == bool(rows)
