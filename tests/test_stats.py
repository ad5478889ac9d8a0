import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fairtract.operators import moments, pca, rank_blocks, resilience

COLUMNS = ["P_CANCER", "P_RESP", "P_DSLPM", "P_PTRAF", "DEMOGIDX_2"]


@pytest.fixture(scope="module")
def tracts():
    rng = np.random.default_rng(3)
    n = 600
    x = rng.normal(size=(n, 3)) * [20, 15, 0.2] + [50, 40, 0.4]
    cancer = 10 + x @ [0.5, 0.2, 15] + rng.normal(size=n) * 5
    resp = 5 + x @ [0.1, 0.6, -8] + rng.normal(size=n) * 5
    state = np.array(["AA"] * 400 + ["BB"] * 150 + ["CC"] * 41 + ["DD"] * 9)
    df = pd.DataFrame(np.column_stack([cancer, resp, x]), columns=COLUMNS)
    df.insert(0, "ID", np.arange(n) + 1_001_000_000)
    df.insert(1, "ST_ABBREV", state)
    df.insert(2, "CNTY_NAME", "County")
    df.loc[5, "P_PTRAF"] = np.nan
    df.loc[410, "P_CANCER"] = np.nan
    return df


def test_narrow_and_wide_moments_agree(spark, tracts):
    df = spark.createDataFrame(tracts)
    key = ["ST_ABBREV", "var1", "var2"]
    narrow = moments.group_moments(df, COLUMNS, ["ST_ABBREV"]).toPandas().set_index(key).sort_index()
    rows = df.na.drop(subset=COLUMNS).select("ST_ABBREV", *COLUMNS)
    wide = moments._wide_moments(rows, COLUMNS, ["ST_ABBREV"]).toPandas().set_index(key).sort_index()
    assert list(narrow.index) == list(wide.index)
    for c in ("n", "mean1", "mean2", "comoment"):
        np.testing.assert_allclose(narrow[c], wide[c], rtol=1e-9, atol=1e-6)


def test_wide_moments_without_keys(spark, tracts):
    rows = spark.createDataFrame(tracts).na.drop(subset=COLUMNS).select(*COLUMNS).repartition(6)
    found = moments._wide_moments(rows, COLUMNS, []).toPandas()
    clean = tracts[COLUMNS].dropna()
    gram = (clean - clean.mean()).T @ (clean - clean.mean())
    for row in found.itertuples():
        assert row.comoment == pytest.approx(gram.loc[row.var1, row.var2])
        assert row.n == len(clean)


def test_spearman_equals_pandas(spark, tracts):
    df = spark.createDataFrame(tracts)
    found = moments.spearman(df, COLUMNS).toPandas().pivot(index="var1", columns="var2", values="rho")
    expected = tracts[COLUMNS].dropna().rank().corr()
    np.testing.assert_allclose(found.loc[COLUMNS, COLUMNS], expected, atol=1e-12)


def test_spearman_of_partitions_in_several_slices(spark, tracts, monkeypatch):
    """A task holds a bounded run of its partition; values that many runs share keep their rank."""
    monkeypatch.setattr(rank_blocks, "SLICE_CELLS", 20)
    before = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    packed, runs = rank_blocks._pack, []
    monkeypatch.setattr(rank_blocks, "_pack", lambda *args: runs.append(args[2]) or packed(*args))
    rows = tracts.assign(P_RESP=(tracts.P_RESP > 30) * 1.0, P_DSLPM=tracts.P_DSLPM.round(0))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
        spark.conf.set("spark.sql.shuffle.partitions", 2)
        found = moments.spearman(spark.createDataFrame(rows), COLUMNS, ["ST_ABBREV"]).toPandas()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert runs == [20]
    for state, own in rows.dropna(subset=COLUMNS).groupby("ST_ABBREV"):
        part = found[found.ST_ABBREV == state].pivot(index="var1", columns="var2", values="rho").loc[COLUMNS, COLUMNS]
        np.testing.assert_allclose(part.to_numpy(dtype=float), own[COLUMNS].corr("spearman").to_numpy(), atol=1e-9)


def test_spearman_counts_repeated_rows(spark):
    rows = [(1.0, 2.0), (1.0, 2.0), (2.0, 1.0), (3.0, 3.0), (5.0, 4.0), (None, 4.0)]
    found = moments.spearman(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).where("var1='a' and var2='b'").head()
    expected = pd.DataFrame(rows[:5]).rank().corr().iloc[0, 1]
    assert found.n == 5 and found.rho == pytest.approx(expected)


def test_standardise_keeps_rows_without_a_key(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 3.0), (None, 4.0), (None, 8.0), ("z", None)], "k string, a double")
    found = moments.standardise(df, ["a"], ["k"]).collect()
    assert sorted(map(tuple, found), key=str) == sorted([("k", -1.0), ("k", 1.0), (None, -1.0), (None, 1.0), ("z", None)], key=str)


def test_correlation_of_constant_column_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double")
    found = {(r.var1, r.var2): r.rho for r in moments.correlations(moments.group_moments(df, ["a", "b"])).collect()}
    assert found == {("a", "a"): 1.0, ("a", "b"): None, ("b", "a"): None, ("b", "b"): None}


def test_standardise_constant_column(spark):
    df = spark.createDataFrame([("k", 1.0, 7.0), ("k", 3.0, 7.0)], "k string, a double, b double")
    found = moments.standardise(df, ["a", "b"], ["k"]).orderBy("a").collect()
    assert [(r.a, r.b) for r in found] == [(-1.0, 0.0), (1.0, 0.0)]


def test_ols_equals_lstsq(spark, tracts):
    fits = moments.ols(spark.createDataFrame(tracts), ["P_CANCER"], COLUMNS[2:], ["ST_ABBREV"]).collect()
    for fit in fits:
        part = tracts[tracts.ST_ABBREV == fit.ST_ABBREV].dropna()
        a = np.column_stack([np.ones(len(part)), part[COLUMNS[2:]]])
        beta = np.linalg.lstsq(a, part.P_CANCER, rcond=None)[0]
        np.testing.assert_allclose([fit.intercept, *fit.coefficients], beta, rtol=1e-6)
        residual = part.P_CANCER - a @ beta
        assert fit.r2 == pytest.approx(1 - (residual**2).sum() / ((part.P_CANCER - part.P_CANCER.mean()) ** 2).sum())


def test_ols_with_dependent_predictors_has_least_norm(spark):
    rows = [(float(i), float(2 * i), 3.0 * i + 1, 5.0) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, y double, flat double")
    fits = {f.outcome: f for f in moments.ols(df, ["y", "flat"], ["a", "b"]).collect()}
    np.testing.assert_allclose(fits["y"].coefficients, [0.6, 1.2], atol=1e-9)
    assert fits["y"].r2 == pytest.approx(1.0)
    assert fits["flat"].r2 == 1.0 and fits["flat"].intercept == pytest.approx(5.0)


def test_ols_does_not_depend_on_units(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200) * 1e8, rng.normal(size=200) * 1e-3
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": 2e-8 * a + 3e3 * b + 1}))
    fit = moments.ols(df, ["y"], ["a", "b"]).head()
    np.testing.assert_allclose([fit.intercept, *fit.coefficients], [1, 2e-8, 3e3], rtol=1e-6)


def test_resilience_and_its_summary(spark, tracts):
    df = spark.createDataFrame(tracts).withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in COLUMNS}
    )
    models = resilience.ols_by_state(df)
    rows = resilience.resilience(df, models).toPandas()
    assert set(rows.ST_ABBREV) == {"AA", "BB", "CC"}
    for state, part in rows.groupby("ST_ABBREV"):
        assert (part.high_vulnerability == (part.DEMOGIDX_2 >= part.DEMOGIDX_2.median())).all()
        assert part.resid_cancer.sum() == pytest.approx(0, abs=1e-6)
        assert (part.resilient_cancer == (part.high_vulnerability & (part.resid_cancer < 0))).all()
    summary = {r.ST_ABBREV: r for r in resilience.resilience_summary(resilience.resilience(df, models), models).collect()}
    assert summary["DD"].n_tracts == 9 and summary["DD"].r2_cancer is None and summary["DD"].n_resilient_resp is None
    assert summary["BB"].n_tracts == 149
    assert summary["AA"].n_resilient_cancer == int(rows[rows.ST_ABBREV == "AA"].resilient_cancer.sum())


def test_state_without_complete_rows_is_listed(spark):
    rows = [("EE", None, 1.0, 1.0, 1.0, 1.0)] + [("FF", float(i % 7), float(i), i * 1.5, float(i * i), i % 3 * 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, "ST_ABBREV string, " + ", ".join(f"{c} double" for c in COLUMNS))
    found = {r.ST_ABBREV: r.n_tracts for r in resilience.ols_by_state(df).collect()}
    assert found == {"EE": 0, "FF": 12}


def test_pca_equals_svd(spark, tracts):
    found = pca.pca(spark.createDataFrame(tracts), COLUMNS, ["ST_ABBREV"]).toPandas()
    for state, part in found.groupby("ST_ABBREV"):
        x = tracts[tracts.ST_ABBREV == state][COLUMNS].dropna().to_numpy()
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        _, s, vt = np.linalg.svd(z, full_matrices=False)
        ratio = part.drop_duplicates("pc").sort_values("pc").var_explained
        np.testing.assert_allclose(ratio, s**2 / (s**2).sum(), atol=1e-10)
        loading = part.pivot(index="pc", columns="variable", values="loading")[COLUMNS].to_numpy()
        np.testing.assert_allclose(np.abs(loading), np.abs(vt), atol=1e-7)
        np.testing.assert_allclose(loading @ loading.T, np.eye(5), atol=1e-10)


def test_pca_by_state_is_padded(spark, tracts):
    rows = pca.pca_by_state(spark.createDataFrame(tracts), COLUMNS).toPandas()
    assert (rows.groupby("ST_ABBREV").size() == 20).all()
    small = rows[rows.ST_ABBREV == "DD"]
    assert (small.n_tracts == 9).all() and small.var_explained.isna().all() and small.top1_var.isna().all()
    big = rows[rows.ST_ABBREV == "AA"].sort_values("PC")
    assert big.var_explained.notna().sum() == 5 and big.var_explained.dropna().is_monotonic_decreasing
    assert set(big.iloc[0][[f"top{i}_var" for i in range(1, 6)]]) == set(COLUMNS)


def test_rank_states(spark):
    rows = [("A", 10, 3, 1, 0.5, 0.7), ("B", 8, 1, 2, 0.9, 0.1), ("C", 5, None, None, None, None)]
    df = spark.createDataFrame(
        rows, "ST_ABBREV string, n_tracts long, n_resilient_cancer long, n_resilient_resp long, r2_cancer double, r2_resp double"
    )
    ranked = resilience.top_states(resilience.rank_states(df), "r2_avg").collect()
    assert [(r.ST_ABBREV, round(r.r2_avg, 6), r.pct_resilient_cancer) for r in ranked] == [("A", 0.6, 30.0), ("B", 0.5, 12.5)]
