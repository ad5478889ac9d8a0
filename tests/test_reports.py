import pytest
from pyspark.sql import functions as F

from fairtract.operators import drivers, joins, rollup
from fairtract.plans import reports
from fairtract.schema import ROLLUP_DEMOGRAPHICS, ROLLUP_ENVIRONMENT

MEASURES = [*ROLLUP_ENVIRONMENT, *ROLLUP_DEMOGRAPHICS]
RECORD = "geoid11 string, cancer array<struct<feature:string,shap:double>>, resp array<struct<feature:string,shap:double>>"


@pytest.fixture(scope="module")
def tracts(spark):
    """State AA: county 01 to 18 with two tracts each, risk falling; one county has no value at all."""
    rows = []
    for i in range(1, 19):
        for j in (0, 1):
            value = None if i == 18 else float(100 - i)
            rows.append((1_000_000_000 + 10 * i + j, "AA", f"County {i:02d}", *[value] * len(MEASURES)))
    rows.append((1_000_000_999, "AA", None, *[50.0] * len(MEASURES)))
    kind = "ID long, ST_ABBREV string, CNTY_NAME string, " + ", ".join(f"{c} double" for c in MEASURES)
    return spark.createDataFrame(rows, kind)


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("01000000010", [("P_UST", 2.0), ("P_PM25", -1.0)], [("P_OZONE", 0.5)]),
        ("01000000011", [("P_UST", 1.0), ("P_DSLPM", 0.2)], [("P_OZONE", -0.5)]),
        ("01000000170", [("P_PNPL", 1.0)], [("P_OZONE", 0.0)]),
        ("01000000171", [("P_PM25", -1.0)], [("P_PM25", -2.0)]),
    ]
    return spark.createDataFrame(rows, RECORD)


def test_missing_county_counts_as_zero_and_shifts_the_state(tracts):
    counties = rollup.county_summary(tracts)
    empty = counties.where(F.col("county") == "County 18").head()
    assert (empty.tract_count, empty.P_CANCER) == (2, 0.0)
    state = rollup.state_summary(counties).head()
    weighted = sum(2 * (100 - i) for i in range(1, 18)) + 50
    assert state.tract_count == 37 and state.county_count == 19
    assert state.P_CANCER == pytest.approx(weighted / 37)
    assert tracts.agg(F.avg("P_CANCER")).head()[0] == pytest.approx(weighted / 35)


def test_nested_summary(tracts, records):
    counts = reports.county_driver_counts(tracts, records)
    row = rollup.nested_summary(rollup.county_summary(tracts), counts).head()
    assert len(row.avg_env) == 12 and len(row.avg_demo) == 2 and row.avg_env["P_CANCER"] == row.avg_cancer
    assert [c.rank for c in row.counties] == list(range(1, 20)) and row.top_cancer[0].feature == "P_UST"


def test_county_ties_go_by_name(spark):
    df = spark.createDataFrame([("AA", "B", 1.0, 3.0), ("AA", "A", 2.0, 2.0), ("AA", "C", 9.0, 9.0)], "ST_ABBREV string, county string, P_CANCER double, P_RESP double")
    ranked = rollup.split_top(rollup.rank_counties(df), 2).orderBy("rank").collect()
    assert [(r.county, r.detailed) for r in ranked] == [("C", True), ("A", True), ("B", False)]


def test_driver_counts_skip_what_does_not_raise_risk(records):
    counts = rollup.driver_counts(records.withColumn("ST_ABBREV", F.lit("AA")), ["ST_ABBREV"])
    found = {(r.outcome, r.feature): r["count"] for r in counts.collect()}
    assert found == {("cancer", "P_UST"): 2, ("cancer", "P_DSLPM"): 1, ("cancer", "P_PNPL"): 1, ("resp", "P_OZONE"): 1}
    top = rollup.driver_frequency(counts, ["ST_ABBREV"], 2).where("outcome = 'cancer'").orderBy("rank").collect()
    assert [r.feature for r in top] == ["P_UST", "P_DSLPM"]


def test_state_report(tracts, records):
    text = reports.state_context(tracts, records).head().context
    lines = text.split("\n")
    assert lines[:4] == ["# State: AA", "Total tracts: 37 | Counties: 19", "", "## Statewide Averages (percentiles)"]
    assert "- Cancer: UST proximity (2 tracts), Diesel PM (1 tracts), NPL sites (1 tracts)" in lines
    assert "- Respiratory: Ozone (1 tracts)" in lines
    first = lines.index("### County 01 (2 tracts)")
    assert lines[first + 1 : first + 6] == [
        "- Avg cancer risk: 99.0 | Avg respiratory risk: 99.0",
        "- Low-income: 99.0 | People of color: 99.0",
        "- Top cancer drivers: UST proximity, Diesel PM",
        "- Top respiratory drivers: Ozone",
        "",
    ]
    assert sum(line.startswith("### ") for line in lines) == 15
    tail = text.split("## Other Counties (compact summary, sorted by risk)\n\n")[1].split("\n")
    assert tail == [
        "- County 16: 2 tracts, cancer 84, resp 84, top driver: —",
        "- County 17: 2 tracts, cancer 83, resp 83, top driver: NPL sites",
        "- Unknown: 1 tracts, cancer 50, resp 50, top driver: —",
        "- County 18: 2 tracts, cancer 0, resp 0, top driver: —",
        "",
    ]


def test_state_report_without_any_driver(tracts, records):
    text = reports.state_context(tracts, records.limit(0)).head().context
    assert "- Cancer: " not in text and "- Top cancer drivers" not in text


def test_tract_report(tracts, records):
    joined = joins.attach_drivers(tracts.withColumn("P_PM25", F.lit(33.25)).withColumn("P_UST", F.lit(None).cast("double")), records)
    found = {r.ID: r.context for r in reports.tract_context(joined).collect()}
    lines = found[1_000_000_010].split("\n")
    assert lines[0] == "Census tract: 1000000010 (AA, County 01)"
    assert "  P_PM25: 33.25" in lines and "  P_OZONE: 99" in lines and not any("P_UST:" in line for line in lines)
    assert lines[-2:] == ["  Cancer risk: UST proximity", "  Respiratory risk: Ozone"]
    assert found[1_000_000_171].endswith("(None of the top factors increase risk in this tract.)")
    assert found[1_000_000_999].startswith("Census tract: 1000000999 (AA, )")
    assert found[1_000_000_999].endswith("SHAP driver data not available for this tract.")


def test_popup_lines(tracts, records):
    rows = {r.ID: r for r in reports.increasing_drivers(joins.attach_drivers(tracts, records)).collect()}
    assert rows[1_000_000_011].cancer_increasing == ["UST proximity increases risk", "Diesel PM increases risk"]
    assert rows[1_000_000_011].resp_increasing == ["None of the top factors increase risk in this tract."]
    assert rows[1_000_000_999].cancer_increasing == ["Driver data not available for this tract."]


def test_result_blocks(spark):
    rows = [("q", i, f"T{i}", f"u{i}", "x" * 2000 if i == 1 else None, ["a", "b"] if i == 2 else []) for i in range(1, 12)]
    results = spark.createDataFrame(rows, "query string, position long, title string, url string, text string, highlights array<string>")
    asked = spark.createDataFrame([("q",), ("none",)], "query string")
    found = {r.query: r.context for r in reports.result_blocks(results, asked).collect()}
    blocks = found["q"].removeprefix('Web search results for "q":\n\n').split("\n\n")
    assert len(blocks) == 8 and blocks[0] == "[1] T1\nURL: u1\n" + "x" * 1500
    assert blocks[1].endswith("\na b") and blocks[2].endswith("\n(No content)")
    assert found["none"] == '[No web results for: "none". Proceed with other context.]'


def test_driver_forms_agree(spark):
    features = ["P_UST", "P_PM25", "P_OZONE", "P_PNPL"]
    columns = [f"shap_{o}_{f}" for o in ("cancer", "resp") for f in features]
    rows = [(7, "AA", "C", 1.0, -1.0, 0.5, -3.0, 0.0, 0.0, 0.0, 0.0), (8, None, "C", *[1.0] * 8)]
    wide = spark.createDataFrame(rows, "ID long, ST_ABBREV string, CNTY_NAME string, " + ", ".join(f"{c} double" for c in columns))
    top = drivers.top_drivers_wide(wide, features)
    one = top.where("ID = 7").head()
    assert [one[f"top_cancer_{r}_feature"] for r in (1, 2, 3)] == ["P_PNPL", "P_PM25", "P_UST"]
    assert [one[f"top_resp_{r}_feature"] for r in (1, 2, 3)] == ["P_OZONE", "P_PM25", "P_PNPL"]
    long = drivers.top_drivers(drivers.to_long(wide, features), ["ID"]).where("ID = 7 and outcome = 'cancer'").orderBy("rank")
    assert [r.feature for r in long.collect()] == ["P_PNPL", "P_PM25", "P_UST"]
    nested = drivers.nest_drivers(top.withColumn("top_cancer_1_shap", F.lit("bad")))
    assert nested.count() == 1 and nested.head().cancer[0] == ("P_PNPL", 0.0)
    importance = {r.feature: r.cancer for r in drivers.pivot_importance(drivers.driver_importance(drivers.to_long(wide, features))).collect()}
    assert importance["P_PNPL"] == 2.0
