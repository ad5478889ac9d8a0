import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairtract import staging
from fairtract.operators import boosting, drivers
from fairtract import schema as names
from fairtract.plans import jobs
from fairtract.sources import readers

FEATURES = ["P_PM25", "P_OZONE", "P_DSLPM", "DEMOGIDX_2"]


@pytest.fixture(scope="module")
def rows(spark):
    def noise(i):
        return F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10_000)) / 100

    df = spark.range(400).select(
        F.col("id").alias("ID"), F.lit("AA").alias("ST_ABBREV"), F.lit("C").alias("CNTY_NAME"),
        *[noise(i).alias(f) for i, f in enumerate(FEATURES)],
    )
    cancer = F.col("P_PM25") * 0.5 + F.when(F.col("P_OZONE") > 50, F.col("P_DSLPM")).otherwise(0.0)
    return df.withColumns({"P_CANCER": cancer, "P_RESP": 100 - F.col("P_DSLPM") * F.col("DEMOGIDX_2") / 100})


@pytest.fixture(scope="module")
def models(rows):
    return [boosting.fit_outcome(rows, FEATURES, o, trees=6, depth=4, min_leaf=5) for o in ("cancer", "resp")]


def _predict(leaves, x):
    return ((leaves.patterns(x) == (1 << leaves.slots) - 1) * leaves.value).sum(axis=1)


def test_leaves_reproduce_the_prediction(spark, rows, models):
    for fitted in models:
        leaves = boosting.leaf_table(spark, fitted)
        scored = boosting.predict(rows, fitted).toPandas()
        np.testing.assert_allclose(
            _predict(leaves, scored[FEATURES].to_numpy()), scored[f"pred_{fitted.outcome}"], atol=1e-9
        )


def test_stored_leaves_score_as_the_model_by_one_path_a_tree(spark, rows, models):
    for fitted in models:
        stored = boosting.leaf_rows(spark, fitted)
        scored = boosting.predict(rows, fitted).withColumn("score", boosting.leaf_score(stored, FEATURES)).toPandas()
        np.testing.assert_allclose(scored.score, scored[f"pred_{fitted.outcome}"], atol=1e-9)
        # As many nodes as the trees have: no leaf is split.
        of_tree = {}
        for r in stored.collect():
            of_tree.setdefault(r.tree, {}).setdefault(r.leaf, (r.value, {}))[1].update({r.feature: (r.low, r.high)} if r.feature else {})
        assert len(of_tree) == 6
        for own in of_tree.values():
            assert len(boosting._nodes(list(own.values()))) == 2 * len(own) - 1


def test_leaves_that_are_no_tree_and_odd_values(spark):
    """A pinwheel of boxes that no cut divides; missing and non-finite values are in no box of their feature."""
    inf = float("inf")
    table = [(0, 1.0, "a", -inf, 2.0), (0, 1.0, "b", -inf, 1.0), (1, 2.0, "a", 2.0, inf), (1, 2.0, "b", -inf, 2.0),
             (2, 4.0, "a", 1.0, inf), (2, 4.0, "b", 2.0, inf), (3, 8.0, "a", -inf, 1.0), (3, 8.0, "b", 1.0, inf), (4, 16.0, None, None, None)]
    leaves = spark.createDataFrame([(*r, 0 if r[0] < 4 else 1) for r in table], "leaf int, value double, feature string, low double, high double, tree int")
    values = [0.5, 1.0, 1.5, 2.0, 2.5, None, float("nan"), inf, -inf]
    df = spark.createDataFrame(list(itertools.product(values, values)), "a double, b double")
    for r in df.withColumn("score", boosting.leaf_score(leaves, ["a", "b"])).collect():
        sure = {k: v for k, v in (("a", r.a), ("b", r.b)) if v is not None and math.isfinite(v)}
        inside = lambda leaf: all(f is None or f in sure and low < sure[f] <= high for i, _, f, low, high in table if i == leaf)
        assert r.score == sum({i: v for i, v, *_ in table if inside(i)}.values())


def test_contributions_add_up_and_equal_brute_force(spark, rows, models):
    background = rows.where(F.col("ID") % 5 == 0)
    scored = rows
    for fitted in models:
        scored = boosting.predict(scored, fitted)
    found = boosting.tree_shap(scored, models, background).toPandas().sort_values("ID")
    x = found[FEATURES].to_numpy()
    for fitted in models:
        leaves = boosting.leaf_table(spark, fitted)
        base = x[found.ID.to_numpy() % 5 == 0]
        shap = found[[f"shap_{fitted.outcome}_{f}" for f in FEATURES]].to_numpy()
        gap = found[f"pred_{fitted.outcome}"] - _predict(leaves, base).mean()
        np.testing.assert_allclose(shap.sum(axis=1), gap, atol=1e-8)
        for i in (0, 57, 399):
            np.testing.assert_allclose(shap[i], _shapley(leaves, x[i], base), atol=1e-8)


def _shapley(leaves, row, base):
    """Shapley values over all feature subsets, missing features taken from the background."""
    p = len(row)

    def worth(subset):
        mixed = base.copy()
        mixed[:, list(subset)] = row[list(subset)]
        return _predict(leaves, mixed).mean()

    out = np.zeros(p)
    for f in range(p):
        others = [g for g in range(p) if g != f]
        for size in range(p):
            weight = math.factorial(size) * math.factorial(p - size - 1) / math.factorial(p)
            for subset in itertools.combinations(others, size):
                out[f] += weight * (worth((*subset, f)) - worth(subset))
    return out


def test_explain_outcomes_end_to_end(rows):
    wide, models = jobs.explain_outcomes(rows, trees=4, min_leaf=5)
    found = wide.select("ID", *drivers.top_columns(), "shap_cancer_P_PM25").toPandas()
    assert len(found) == 400 and [m.outcome for m in models] == ["cancer", "resp"]
    assert (found.top_cancer_1_shap.abs() >= found.top_cancer_2_shap.abs()).all()


def test_bounded_fit_explains_all_rows(rows):
    wide, _ = jobs.explain_outcomes(rows, max_fit_rows=150, trees=2, min_leaf=5)
    assert wide.count() == 400 and wide.where("shap_cancer_P_PM25 is null").count() == 0


def test_model_data_names_missing_features(rows):
    _, available, missing = boosting.model_data(rows)
    assert available == FEATURES and "RPL_EJI" in missing


def test_residual_table(rows, models):
    found = boosting.residual_table(rows, models).toPandas()
    assert len(found) == 800
    np.testing.assert_allclose(found.residual, found.actual - found.predicted)


def test_analysis_chain_writes_every_table(spark, rows, tmp_path, monkeypatch):
    folder = str(tmp_path / "analysis")
    tracts = rows.withColumn("P_PTRAF", F.col("P_OZONE") / 2)
    index = rows.select(F.lpad(F.col("ID").cast("string"), 11, "0").alias("GEOID"), (F.col("ID") / 400).alias("RPL_EJI"))
    source, staged = str(tmp_path / "tracts"), str(tmp_path / "staged")
    tracts.write.parquet(source)
    monkeypatch.setattr(staging, "scratch_dir", lambda spark: staged)
    report = jobs.analyse(spark.read.parquet(source), index, folder, trees=2, min_leaf=5)
    assert list((tmp_path / "staged").glob("*")) == []
    assert sorted(map(tuple, report.collect()), key=str) == [("AA", 400, 1), (None, 400, 1)]
    for name, count in {
        "analysis_minimal": 400, "pca_by_state": 20, "resilience_all_states": 400, "resilience_by_state": 1,
        "tract_shap": 400, "shap_importance": 6,
    }.items():
        assert spark.read.option("header", True).csv(f"{folder}/{name}").count() == count, name
    records = readers.read_keyed_json(spark, f"{folder}/shap", names.DRIVER_RECORD)
    assert records.count() == 400 and len(records.head().value.resp) == 3
