"""Text reports per tract, per state and per search, built in bulk as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtract.functions.scalars import county_or_unknown, fixed, label, plain_number
from fairtract.operators import joins, rollup
from fairtract.schema import DEMOGRAPHIC_LABELS, ENVIRONMENT_COLUMNS, OUTCOME_COLUMNS
from fairtract.staging import stage

STATE = "ST_ABBREV"

# Wording of the reports.
TRACT_TITLE = "Census tract: "
DEMOGRAPHICS_TITLE = "Demographics (use these to tailor equity and outreach):"
ENVIRONMENT_TITLE = "Environmental indicators (percentiles):"
OUTCOMES_TITLE = "Outcomes (risk indicators):"
OUTCOME_LINES = {"cancer": "  P_CANCER (cancer risk): ", "resp": "  P_RESP (respiratory hazard): "}
DRIVERS_TITLE = "Top environmental factors that INCREASE risk in this tract (from SHAP analysis):"
DRIVER_LINES = {"cancer": "  Cancer risk: ", "resp": "  Respiratory risk: "}
NO_INCREASE = "  (None of the top factors increase risk in this tract.)"
NO_DRIVERS = "SHAP driver data not available for this tract."
POPUP_NO_INCREASE = "None of the top factors increase risk in this tract."
POPUP_NO_DRIVERS = "Driver data not available for this tract."
POPUP_SUFFIX = " increases risk"
STATE_AVERAGES_TITLE = "## Statewide Averages (percentiles)"
STATE_DRIVERS_TITLE = "## Statewide Top Risk Drivers (SHAP analysis, by frequency across tracts)"
OTHER_COUNTIES_TITLE = "## Other Counties (compact summary, sorted by risk)"
TOP_COUNTIES = 15
STATE_TITLE = "# State: "
STATE_TRACTS, STATE_COUNTIES = "Total tracts: ", " | Counties: "
AVERAGE_LINES = {
    "P_CANCER": "- Cancer risk: ",
    "P_RESP": "- Respiratory risk: ",
    "P_LOWINCPCT": "- Low-income population: ",
    "P_PEOPCOLORPCT": "- People of color: ",
}
STATE_DRIVER_LINES = {"cancer": "- Cancer: ", "resp": "- Respiratory: "}
TOP_COUNTIES_TITLE = "## Top {n} Highest-Risk Counties (by average cancer + respiratory risk)"
COUNTY_TITLE, TRACTS_SUFFIX, COUNTED_SUFFIX = "### ", " tracts)", " tracts)"
COUNTY_RISKS = ("- Avg cancer risk: ", " | Avg respiratory risk: ")
COUNTY_PEOPLE = ("- Low-income: ", " | People of color: ")
COUNTY_DRIVER_LINES = {"cancer": "- Top cancer drivers: ", "resp": "- Top respiratory drivers: "}
COMPACT_PARTS = ("- ", ": ", " tracts, cancer ", ", resp ", ", top driver: ")
NO_DRIVER = "—"
RESULTS_TITLE = ('Web search results for "', '":\n\n')
NO_RESULTS = ('[No web results for: "', '". Proceed with other context.]')
RESULT_PARTS = ("[", "] ", "\nURL: ", "\n")
NO_CONTENT = "(No content)"


def _lines(*parts: Column) -> Column:
    """Lines that are present, joined; a NULL line is left out."""
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def _optional(prefix: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(prefix), value))


def _increasing(drivers: Column) -> Column:
    positive = F.filter(drivers, lambda d: d["shap"] > 0)
    return F.transform(positive, lambda d: label(d["feature"]))


def increasing_drivers(df: DataFrame) -> DataFrame:
    """Add ``<outcome>_increasing``: a line per feature that raises risk, or the fallback line."""
    absent = F.col("cancer").isNull() & F.col("resp").isNull()
    columns = {}
    for outcome in OUTCOME_COLUMNS:
        labels = _increasing(F.col(outcome))
        columns[f"{outcome}_increasing"] = (
            F.when(absent, F.array(F.lit(POPUP_NO_DRIVERS)))
            .when(F.size(labels) > 0, F.transform(labels, lambda x: F.concat(x, F.lit(POPUP_SUFFIX))))
            .otherwise(F.array(F.lit(POPUP_NO_INCREASE)))
        )
    return df.withColumns(columns)


def tract_context(df: DataFrame) -> DataFrame:
    """One report per tract from its record and its driver lists (``attach_drivers``)."""
    blank = F.lit("")
    title = F.concat(
        F.lit(TRACT_TITLE),
        F.col("ID").cast("string"),
        F.lit(" ("),
        F.coalesce(F.col(STATE), blank),
        F.lit(", "),
        F.coalesce(F.col("CNTY_NAME"), blank),
        F.lit(")"),
    )
    demographics = [
        _optional(f"  {text}: ", plain_number(F.col(c))) for c, text in DEMOGRAPHIC_LABELS.items() if c in df.columns
    ]
    environment = [_optional(f"  {c}: ", plain_number(F.col(c))) for c in ENVIRONMENT_COLUMNS if c in df.columns]
    outcomes = [
        _optional(OUTCOME_LINES[name], plain_number(F.col(c))) for name, c in OUTCOME_COLUMNS.items()
    ]
    increasing = {name: _increasing(F.col(name)) for name in OUTCOME_COLUMNS}
    has_record = F.col("cancer").isNotNull() | F.col("resp").isNotNull()
    none = F.lit(True)
    drivers = []
    for name, labels in increasing.items():
        some = F.coalesce(F.size(labels), F.lit(0)) > 0
        none = none & ~some
        drivers.append(F.when(has_record & some, F.concat(F.lit(DRIVER_LINES[name]), F.array_join(labels, ", "))))
    text = _lines(
        title,
        blank,
        F.lit(DEMOGRAPHICS_TITLE),
        *demographics,
        blank,
        F.lit(ENVIRONMENT_TITLE),
        *environment,
        blank,
        F.lit(OUTCOMES_TITLE),
        *outcomes,
        blank,
        F.when(has_record, DRIVERS_TITLE).otherwise(NO_DRIVERS),
        *drivers,
        F.when(has_record & none, NO_INCREASE),
    )
    return df.withColumn("context", text)


def _names(drivers: Column) -> Column:
    return F.array_join(F.transform(drivers, lambda d: label(d["feature"])), ", ")


def _counted(drivers: Column) -> Column:
    shown = lambda d: F.concat(label(d["feature"]), F.lit(" ("), d["count"].cast("string"), F.lit(COUNTED_SUFFIX))
    return F.array_join(F.transform(drivers, shown), ", ")


def _some(drivers: Column) -> Column:
    return F.coalesce(F.size(drivers), F.lit(0)) > 0


def _county_detail() -> Column:
    return _lines(
        F.concat(F.lit(COUNTY_TITLE), "county", F.lit(" ("), F.col("tract_count").cast("string"), F.lit(TRACTS_SUFFIX)),
        F.concat(
            F.lit(COUNTY_RISKS[0]), fixed(F.col("P_CANCER"), 1),
            F.lit(COUNTY_RISKS[1]), fixed(F.col("P_RESP"), 1),
        ),
        F.concat(
            F.lit(COUNTY_PEOPLE[0]), fixed(F.col("P_LOWINCPCT"), 1, "N/A"),
            F.lit(COUNTY_PEOPLE[1]), fixed(F.col("P_PEOPCOLORPCT"), 1, "N/A"),
        ),
        F.when(_some(F.col("top_cancer")), F.concat(F.lit(COUNTY_DRIVER_LINES["cancer"]), _names(F.col("top_cancer")))),
        F.when(_some(F.col("top_resp")), F.concat(F.lit(COUNTY_DRIVER_LINES["resp"]), _names(F.col("top_resp")))),
        F.lit(""),
    )


def _county_line() -> Column:
    first = F.coalesce(
        F.get(F.col("top_cancer"), F.lit(0))["feature"], F.get(F.col("top_resp"), F.lit(0))["feature"], F.lit(NO_DRIVER)
    )
    return F.concat(
        F.lit(COMPACT_PARTS[0]), "county", F.lit(COMPACT_PARTS[1]), F.col("tract_count").cast("string"),
        F.lit(COMPACT_PARTS[2]), fixed(F.col("P_CANCER"), 0),
        F.lit(COMPACT_PARTS[3]), fixed(F.col("P_RESP"), 0),
        F.lit(COMPACT_PARTS[4]), label(first),
    )


def county_driver_counts(tracts: DataFrame, drivers: DataFrame) -> DataFrame:
    """Driver counts per county, stored: county and state lists both come from them."""
    named = tracts.select("ID", STATE, county_or_unknown(F.col("CNTY_NAME")).alias("county"))
    return stage(rollup.driver_counts(joins.attach_drivers(named, drivers), [STATE, "county"]), "driver-counts")


def county_report(tracts: DataFrame, counts: DataFrame) -> DataFrame:
    """Counties with means, driver lists, rank and the detailed flag."""
    keys = [STATE, "county"]
    lists = rollup.driver_lists(rollup.driver_frequency(counts, keys, 3), keys)
    counties = rollup.county_summary(tracts).join(lists, keys, "left")
    return rollup.split_top(rollup.rank_counties(counties), TOP_COUNTIES)


def state_context(tracts: DataFrame, drivers: DataFrame) -> DataFrame:
    """One report per state: averages, top drivers, detailed and compact counties.

    Tracts are read twice, once for the means and once for the driver counts,
    and reduced to one row per county; a state's text is put together from
    its counties.
    """
    counts = county_driver_counts(tracts, drivers)
    counties = stage(county_report(tracts, counts), "counties")
    lists = rollup.driver_lists(rollup.driver_frequency(counts, [STATE], 5), [STATE])
    states = rollup.state_summary(counties).join(lists, STATE, "left")
    text = F.when(F.col("detailed"), _county_detail()).otherwise(_county_line())
    entry = counties.select(STATE, "rank", "detailed", text.alias("text"))
    folded = entry.groupBy(STATE).agg(F.array_sort(F.collect_list(F.struct("rank", "detailed", "text"))).alias("lines"))
    joined = states.join(folded, STATE)
    detailed = F.filter(F.col("lines"), lambda e: e["detailed"])
    compact = F.filter(F.col("lines"), lambda e: ~e["detailed"])
    blank = F.lit("")
    report = _lines(
        F.concat(F.lit(STATE_TITLE), STATE),
        F.concat(
            F.lit(STATE_TRACTS), F.col("tract_count").cast("string"),
            F.lit(STATE_COUNTIES), F.col("county_count").cast("string"),
        ),
        blank,
        F.lit(STATE_AVERAGES_TITLE),
        F.concat(F.lit(AVERAGE_LINES["P_CANCER"]), fixed(F.col("P_CANCER"), 1)),
        F.concat(F.lit(AVERAGE_LINES["P_RESP"]), fixed(F.col("P_RESP"), 1)),
        F.concat(F.lit(AVERAGE_LINES["P_LOWINCPCT"]), fixed(F.col("P_LOWINCPCT"), 1, "N/A")),
        F.concat(F.lit(AVERAGE_LINES["P_PEOPCOLORPCT"]), fixed(F.col("P_PEOPCOLORPCT"), 1, "N/A")),
        blank,
        F.lit(STATE_DRIVERS_TITLE),
        F.when(_some(F.col("top_cancer")), F.concat(F.lit(STATE_DRIVER_LINES["cancer"]), _counted(F.col("top_cancer")))),
        F.when(_some(F.col("top_resp")), F.concat(F.lit(STATE_DRIVER_LINES["resp"]), _counted(F.col("top_resp")))),
        blank,
        F.lit(TOP_COUNTIES_TITLE.format(n=TOP_COUNTIES)),
        blank,
        F.array_join(F.transform(detailed, lambda e: e["text"]), "\n"),
        F.when(
            F.size(compact) > 0,
            F.concat(
                F.lit(OTHER_COUNTIES_TITLE + "\n\n"),
                F.array_join(F.transform(compact, lambda e: e["text"]), "\n"),
                F.lit("\n"),
            ),
        ),
    )
    return joined.select(STATE, report.alias("context"))


def result_blocks(
    results: DataFrame, queries: DataFrame, n: int = 8, chars: int = 1500
) -> DataFrame:
    """Search results as one text per query.

    ``results``: ``query, position, title, url, text, highlights``. The best
    ``n`` by position, then url, are kept per query, which Spark limits before the shuffle, so a
    query with very many results is no hot group. Queries without results get
    a message.
    """
    best = Window.partitionBy("query").orderBy("position", "url")
    kept = results.withColumn("i", F.row_number().over(best)).where(F.col("i") <= n)
    text = F.coalesce(F.substring("text", 1, chars), F.array_join("highlights", " "))
    content = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, NO_CONTENT).otherwise(text)
    block = F.concat(
        F.lit(RESULT_PARTS[0]), F.col("i").cast("string"), F.lit(RESULT_PARTS[1]), F.col("title"), F.lit(RESULT_PARTS[2]), F.col("url"), F.lit(RESULT_PARTS[3]), content
    )
    blocks = F.array_sort(F.collect_list(F.struct("i", block.alias("block"))))
    texts = kept.groupBy("query").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("body"))
    found = F.concat(F.lit(RESULTS_TITLE[0]), F.col("query"), F.lit(RESULTS_TITLE[1]), F.col("body"))
    nothing = F.concat(F.lit(NO_RESULTS[0]), F.col("query"), F.lit(NO_RESULTS[1]))
    return queries.select("query").distinct().join(texts, "query", "left").select(
        "query", F.when(F.col("body").isNotNull(), found).otherwise(nothing).alias("context")
    )
