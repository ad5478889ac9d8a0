import numpy as np
import pandas as pd
import pytest

from fairtract.operators import ranks
from fairtract.operators.sampling import quotas, stratified_sample


@pytest.fixture(scope="module")
def skewed():
    """One group with most rows, one value with a third of them, missing values and NaN."""
    rng = np.random.default_rng(7)
    n = 5000
    values = np.where(rng.random(n) < 0.35, 0.0, rng.normal(size=n).round(2))
    values[rng.random(n) < 0.05] = np.nan
    state = np.where(rng.random(n) < 0.7, "BIG", rng.choice(["A", "B", "C"], n))
    return pd.DataFrame({"ID": np.arange(n), "ST_ABBREV": state, "x": values, "y": rng.integers(0, 5, n).astype(float)})


@pytest.mark.parametrize("partitions", ["1", "4", "16"])
def test_ranks_equal_pandas(spark, skewed, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame(skewed).repartition(5)
        found = ranks.rank_columns(df, ["ID", "ST_ABBREV"], ["x", "y"], ranks.average_rank(), ["ST_ABBREV"])
        found = found.toPandas().sort_values("ID")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = skewed.groupby("ST_ABBREV")[["x", "y"]].rank()
    for c in ("x", "y"):
        np.testing.assert_allclose(found[c].to_numpy(dtype=float), expected[c].to_numpy())


def test_percent_rank_of_single_row(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", 1.0), (3, "b", 2.0), (4, "b", None)], "ID long, k string, x double")
    found = ranks.rank_columns(df, ["ID", "k"], ["x"], ranks.percent_rank(), ["k"]).collect()
    assert {r.ID: r.x for r in found} == {1: 0.0, 2: 0.0, 3: 1.0, 4: None}


def test_quantiles_equal_numpy(spark, skewed):
    df = spark.createDataFrame(skewed)
    found = ranks.exact_quantiles(df, ["x"], {"q10": 0.1, "q50": 0.5, "q99": 0.99}, ["ST_ABBREV"]).collect()
    for row in found:
        x = skewed.loc[skewed.ST_ABBREV == row.ST_ABBREV, "x"].dropna()
        np.testing.assert_allclose([row.q10, row.q50, row.q99], np.quantile(x, [0.1, 0.5, 0.99]))
    assert len(found) == 4


@pytest.mark.parametrize(("small", "margin"), [(100, 4e-4), (100, 0.05), (0, 0.0)])
def test_brackets_are_exact_and_a_miss_is_made_up(spark, skewed, monkeypatch, small, margin):
    monkeypatch.setattr(ranks, "SMALL", small)
    monkeypatch.setattr(ranks, "MARGIN", margin)
    df = spark.createDataFrame(skewed)
    found = ranks.exact_quantiles(df, ["x", "y"], {"low": 0.01, "mid": 0.5, "high": 0.9, "end": 1.0}, ["ST_ABBREV"]).collect()
    assert len(found) == 8
    for row in found:
        x = skewed.loc[skewed.ST_ABBREV == row.ST_ABBREV, row.variable].dropna()
        np.testing.assert_allclose([row.low, row.mid, row.high, row.end], np.quantile(x, [0.01, 0.5, 0.9, 1.0]))


def test_sample_is_exact_and_repeatable(spark, skewed):
    df = spark.createDataFrame(skewed)
    one = {r.ID for r in stratified_sample(df.repartition(3), 501).collect()}
    two = {r.ID for r in stratified_sample(df.repartition(11), 501).collect()}
    assert len(one) == 501 and one == two
    share = skewed.ST_ABBREV.value_counts() * 501 / len(skewed)
    drawn = skewed[skewed.ID.isin(one)].ST_ABBREV.value_counts()
    assert (np.abs(drawn - share) < 1).all()
    assert {r.ST_ABBREV: r.quota for r in quotas(df, 501).collect()} == drawn.to_dict()


def test_sample_of_copies_keeps_its_size(spark):
    rows = [(1, "A")] * 400 + [(i, "A") for i in range(2, 302)] + [(i, "B") for i in range(900, 1000)]
    df = spark.createDataFrame(rows, "ID long, ST_ABBREV string").repartition(7)
    assert stratified_sample(df, 200).count() == 200


def test_sample_keeps_small_input(spark, skewed):
    df = spark.createDataFrame(skewed)
    assert stratified_sample(df, None).count() == stratified_sample(df, 10**6).count() == len(skewed)
    assert stratified_sample(df, None).count() == len(skewed)
