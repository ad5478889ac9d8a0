"""Sums against exact rational arithmetic, in many orders."""

import math
import random
from fractions import Fraction

from pyspark.sql import functions as F

from fairtract.functions.sums import exact_mean, exact_sum


def test_sums_equal_exact_arithmetic_in_any_order(spark):
    random.seed(1)
    groups = {
        "percentiles": [100 * random.randrange(300) / 299 for _ in range(3_000)],
        "wide": [random.uniform(-1, 1) * 10 ** random.randint(-15, 17) for _ in range(3_000)],
        "cancelling": [2.0**55, 1.0, -(2.0**55), 2.0**-40, -1.0],
        "negative": [-0.1] * 10,
        "missing": [None, None],
        "large": [1e300, 1.0, None],
    }
    rows = [(k, x) for k, values in groups.items() for x in values]
    df = spark.createDataFrame(rows, "k string, x double")
    found = []
    for n in (1, 4, 16):
        sums = df.orderBy(F.rand(n)).repartition(n).groupBy("k").agg(exact_sum(F.col("x")).alias("s"), exact_mean(F.col("x")).alias("m"))
        found.append({r.k: (r.s, r.m) for r in sums.collect()})
    assert found[0] == found[1] == found[2]
    for k, values in groups.items():
        kept = [x for x in values if x is not None]
        exact = float(sum(map(Fraction, kept))) if kept else None
        assert found[0][k][0] == exact, k
        assert found[0][k][1] == (exact / len(kept) if kept else None)


def test_odd_values(spark):
    df = spark.createDataFrame([("nan", math.nan), ("nan", 1.0), ("inf", math.inf), ("inf", 2.0), ("zero", -0.0)], "k string, x double")
    found = {r.k: r.s for r in df.groupBy("k").agg(exact_sum(F.col("x")).alias("s")).collect()}
    assert math.isnan(found["nan"]) and found["inf"] == math.inf and found["zero"] == 0.0
    assert df.where("false").agg(exact_mean(F.col("x"))).first()[0] is None
