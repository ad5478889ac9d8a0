import pytest
from pyspark.sql import functions as F

from fairtract.functions import scalars, text
from fairtract.operators import aggregates


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_geoid11_pads_but_never_cuts(spark):
    ids = ["1001020100", "US-1001020100", "123456789012345", "", "1001020100.0"]
    assert values(spark, lambda v: scalars.geoid11(v), ids) == [
        "01001020100", "01001020100", "123456789012345", "00000000000", "10010201000",
    ]


def test_geoid11_int_drops_the_fraction(spark):
    assert values(spark, lambda v: scalars.geoid11_int(v), [1001020100.0, None], "double") == ["01001020100", None]


def test_to_numeric_or_null(spark):
    assert values(spark, lambda v: scalars.to_numeric_or_null(v), ["12", "x12", None]) == [12, None, None]


def test_format_key(spark):
    keys = ["P_PM25", "avg_cancer_risk", "already Upper", "a-b", "éa"]
    assert values(spark, lambda v: scalars.format_key(v), keys) == ["P PM25", "Avg Cancer Risk", "Already Upper", "A-B", "éA"]


def test_format_value(spark):
    numbers = [None, 5.0, 33.5, 0.12345, 1e-6, -2.50001, 12345678.25]
    assert values(spark, lambda v: scalars.format_value(v), numbers, "double") == [
        "—", "5", "33.5", "0.1235", "0", "-2.5", "12345678.25",
    ]


def test_fixed_marks_missing(spark):
    assert values(spark, lambda v: scalars.fixed(v, 1), [None, float("nan"), 2.25, 10.0], "double") == ["—", "—", "2.3", "10.0"]


def test_plain_number_has_no_exponent(spark):
    numbers = [50.0, 33.5, 0.0, 0.0001234, 12345678.9, 1e15, -0.25]
    assert values(spark, lambda v: scalars.plain_number(v), numbers, "double") == [
        "50", "33.5", "0", "0.0001234", "12345678.9", "1000000000000000", "-0.25",
    ]


def test_label_falls_back_to_the_code(spark):
    assert values(spark, lambda v: scalars.label(v), ["P_UST", "OTHER"]) == ["UST proximity", "OTHER"]
    assert values(spark, lambda v: scalars.demographic_label(v), ["P_LOWINCPCT", "P_UST"])[1] == "P_UST"


def test_location_label_skips_empty_parts(spark):
    df = spark.createDataFrame([("Indiana", "", None, 18)], "a string, b string, c string, d long")
    label = scalars.location_label(*[F.col(c) for c in "abcd"])
    assert df.select(label).head()[0] == "Indiana · 18"


def test_json_row_keeps_nulls(spark):
    df = spark.createDataFrame([(1, float("nan"), None)], "a long, b double, c string")
    row = scalars.nan_to_null(df).select(scalars.json_row("a", "b", "c")).head()[0]
    assert row == '{"a":1,"b":null,"c":null}'


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("<p>a</p><script>x < y</script><SCRIPT src=1>\n</script>b", "a b"),
        ("<style>p{}</style>  a\t\n<br/>b ", "a b"),
        ("<scripty>kept</scripty>", "kept"),
        ("<script>never closed", "never closed"),
        ("\ufeff a\u00a0\u2003b\u3000\ufeffc\u0085d\u00a0", "a b c\u0085d"),
    ],
)
def test_strip_html(spark, raw, clean):
    assert values(spark, lambda v: text.strip_html(v), [raw]) == [clean]


def test_strip_html_takes_long_scripts(spark):
    page = "<script>" + "a<b " * 200_000 + "</script>end"
    assert values(spark, lambda v: text.strip_html(v), [page]) == ["end"]


def test_truncate_text(spark):
    assert values(spark, lambda v: text.truncate_text(v, 3), ["abc", "abcd"]) == ["abc", "abc\n\n[Content truncated.]"]


@pytest.mark.parametrize(
    ("raw", "body"),
    [
        ("```markdown\n# T\ntext\n```", "# T\ntext"),
        ("```md\nx\n```  ", "x"),
        ("Sure:\n```\nx\ny\n```\nbye", "x\ny"),
        ("  plain ``` inline  ", "plain ``` inline"),
        ("```\na\n```\n```\nb\n```", "a"),
        ("\ufeff\u00a0x\u00a0y \ufeff", "x\u00a0y"),
    ],
)
def test_unwrap_fence(spark, raw, body):
    assert values(spark, lambda v: text.unwrap_fence(v), [raw]) == [body]


def test_ramp_ends_and_middle(spark):
    def colour(v):
        return aggregates.ramp_colour(v, F.lit(0.0), F.lit(5.0), F.lit(10.0))

    assert values(spark, colour, [0.0, 5.0, 10.0, -3.0, 99.0, None], "double") == [
        "#fff5f0", "#fc9272", "#67000d", "#fff5f0", "#67000d", None,
    ]


def test_indicator_scale_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame(
        [("a", None), ("b", 4.0), ("b", float("inf")), ("c", 1.0), ("c", 3.0), ("c", float("nan"))], "k string, v double"
    )
    found = {r.k: (r.low, r.mid, r.high) for r in aggregates.indicator_scale(df, "v", ["k"]).collect()}
    assert found == {"a": (0.0, 0.5, 1.0), "b": (4.0, 4.5, 5.0), "c": (1.0, 2.0, 3.0)}


def test_bounds_ignore_other_types_and_bad_positions(spark):
    rows = [
        ("Point", "[3, 4]"), ("Point", "[9]"), ("LineString", "[[99, 99]]"),
        ("Polygon", "[[[0, 1], [2, -1], [null, 7]]]"), ("MultiPolygon", "[[[[-5, 0], [1, 8, 3]]], [[[1, 1]]]]"),
    ]
    df = spark.createDataFrame([((t, c),) for t, c in rows], "geometry struct<type:string,coordinates:string>")
    assert tuple(aggregates.bounds(df).head()) == (-5.0, -1.0, 3.0, 8.0)
    assert tuple(aggregates.bounds(df.where("geometry.type = 'LineString'")).head()) == (None,) * 4


def test_histogram_of_one_value_and_empty_bins(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 10.0), ("b", None)], "k string, v double")
    rows = aggregates.histogram(df, "v", 5, ["k"]).orderBy("k", "bin").collect()
    assert [r.n for r in rows if r.k == "a"] == [0, 0, 2, 0, 0]
    assert [r.n for r in rows if r.k == "b"] == [1, 0, 0, 0, 1]


def test_r2_of_constant_outcome(spark):
    df = spark.createDataFrame(
        [("same", 2.0, 2.0), ("same", 2.0, 2.0), ("off", 2.0, 1.0), ("off", 2.0, 3.0), ("fit", 1.0, 1.0), ("fit", 2.0, 2.0)],
        "k string, y double, p double",
    )
    found = {r.k: (r.r2, r.r2_pearson) for r in aggregates.fit_r2(df, "y", "p", ["k"]).collect()}
    assert found == {"same": (1.0, None), "off": (0.0, None), "fit": (1.0, 1.0)}


def test_describe_lists_a_column_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, float("nan"))], "a double, b double")
    found = {r.variable: r for r in aggregates.describe(df).collect()}
    assert (found["a"]["count"], found["a"].q25, found["a"].q50, found["a"].max) == (3, 1.5, 2.0, 4.0)
    assert found["b"]["count"] == 0 and found["b"].mean is None and found["b"].q50 is None
