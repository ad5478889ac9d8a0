"""One query per operator over the tract-shaped tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtract import schema as names
from fairtract.functions import scalars, text
from fairtract.operators import aggregates, boosting, drivers, joins, moments, pca, ranks, resilience, rollup, select
from fairtract.operators.sampling import stratified_sample
from fairtract.plans import jobs, reports
from fairtract.sources import readers, writers
from fairtract.staging import new_path, stage
from workload import sql, tables
from workload.sql import COUNTY, DRIVERS, INDEX, OLS, OLS_ALL, P_COLUMNS, RESILIENCE, ROLLUP, UNIT, fixed1, labelled, plain, r6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Query) -> Query:
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def r(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def rounded(df: DataFrame, columns, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(F.col(c), digits) for c in columns})


def _r(columns, digits: int = 6) -> str:
    return ", ".join(f"{r6(c, digits)} {c}" for c in columns)


BASE = ["ID", "ST_ABBREV", "STATE_NAME", "CNTY_NAME"]
MAP_COLUMNS = [c for c in names.FEATURE_COLUMNS if c == "ID" or c in ("ST_ABBREV", "CNTY_NAME") or c in P_COLUMNS]
MAP_P = [c for c in MAP_COLUMNS if c.startswith("P_")]


# ---- sources and sinks -------------------------------------------------------------------


@query("read_indicators", f"{UNIT} select {', '.join(BASE)}, {_r(['DEMOGIDX_2', *P_COLUMNS])} from unit")
def _(spark, sf):
    path = new_path(spark, "indicators-csv")
    # NaN in the file must come back as a missing value.
    source = tables.unit(spark, sf).withColumn("P_PTRAF", F.coalesce("P_PTRAF", F.lit(float("nan"))))
    writers.write_csv(source, path)
    return rounded(readers.read_indicators(spark, path), ["DEMOGIDX_2", *P_COLUMNS])


@query("first_existing", "select * from customer")
def _(spark, sf):
    return spark.read.parquet(readers.first_existing(spark, [f"{sf}/no-such-table.parquet", f"{sf}/customer.parquet"]))


def _with_geometry(spark, sf):
    return joins.join_geometry(tables.unit(spark, sf), tables.boundaries(spark, sf))


GEO = f"""{UNIT},
geo as (select *, cast(ID % 360 - 180 as double) lng, cast(ID % 170 - 85 as double) lat
  from unit where P_PTRAF is not null)"""


@query(
    "read_features",
    f"""{GEO} select {', '.join(MAP_COLUMNS[:3])}, {_r(MAP_P)}, 'Polygon' shape,
    concat('[[[', lng, ',', lat, '],[', lng+1, ',', lat, '],[', lng+1, ',', lat+1, '],[', lng, ',', lat, ']]]') coordinates
    from geo""",
)
def _(spark, sf):
    folder = new_path(spark, "features")
    writers.write_features(_with_geometry(spark, sf), folder)
    rows = readers.read_features(spark, folder)
    flat = rows.select("properties.*", F.col("geometry.type").alias("shape"), F.col("geometry.coordinates").alias("coordinates"))
    return rounded(flat.drop("P_RSEI_AIR"), MAP_P)


@query(
    "write_features",
    f"{GEO} select ST_ABBREV state, count(*) features, count(CNTY_NAME) named, {r6('avg(P_CANCER)')} p_cancer from geo group by 1",
)
def _(spark, sf):
    folder = new_path(spark, "collections")
    writers.write_feature_collections(_with_geometry(spark, sf), folder, per_document=50)
    rows = readers.read_feature_collections(spark, folder)
    return rows.groupBy(F.col("properties.ST_ABBREV").alias("state")).agg(
        F.count("*").alias("features"),
        F.count("properties.CNTY_NAME").alias("named"),
        r(F.avg("properties.P_CANCER")).alias("p_cancer"),
    )


@query(
    "read_keyed_json",
    f"""{UNIT} select lpad(cast(ID as varchar),11,'0') geoid11, ID, CNTY_NAME, {_r(['P_CANCER', 'P_PTRAF'])}, ST_ABBREV state from unit""",
)
def _(spark, sf):
    folder = new_path(spark, "records")
    source = tables.unit(spark, sf).withColumn("geoid11", tables.geoid())
    writers.write_keyed_json(source, folder, "geoid11", per_object=50)
    kept = names.schema_for(["ID", "CNTY_NAME", "P_CANCER", "P_PTRAF"])
    rows = readers.read_keyed_json(spark, folder, kept)
    return rounded(rows.select("geoid11", "value.*", "state"), ["P_CANCER", "P_PTRAF"])


@query("write_keyed_json", f"{DRIVERS} select ST_ABBREV state, count(*) entries, {r6('sum(shap_cancer_P_DSLPM)', 3)} total from contrib group by 1")
def _(spark, sf):
    folder = new_path(spark, "driver-records")
    records = tables.driver_records(spark, sf).withColumn("record", F.to_json(F.struct("cancer", "resp")))
    writers.write_keyed_json(records, folder, "geoid11", F.col("record"), per_object=50)
    rows = readers.read_keyed_json(spark, folder, names.DRIVER_RECORD)
    diesel = F.filter("value.cancer", lambda d: d["feature"] == "P_DSLPM")[0]["shap"]
    return rows.groupBy("state").agg(F.count("*").alias("entries"), r(F.sum(diesel), 3).alias("total"))


@query("read_classic_features", ORACLES["read_features"])
def _(spark, sf):
    """One document per state, read in ranges of bytes."""
    folder = new_path(spark, "classic-features")
    writers.write_classic_collections(_with_geometry(spark, sf), folder)
    rows = readers.read_feature_collections(spark, folder, whole=True, range_bytes=32_768)
    flat = rows.select("properties.*", F.col("geometry.type").alias("shape"), F.col("geometry.coordinates").alias("coordinates"))
    return rounded(flat.drop("P_RSEI_AIR"), MAP_P)


@query("read_classic_keyed_json", ORACLES["read_keyed_json"])
def _(spark, sf):
    folder = new_path(spark, "classic-records")
    source = tables.unit(spark, sf).withColumn("geoid11", tables.geoid())
    writers.write_classic_keyed_json(source, folder, "geoid11")
    kept = names.schema_for(["ID", "CNTY_NAME", "P_CANCER", "P_PTRAF"])
    rows = readers.read_keyed_json(spark, folder, kept, whole=True, range_bytes=32_768)
    return rounded(rows.select("geoid11", "value.*", "state"), ["P_CANCER", "P_PTRAF"])


@query(
    "republish_state",
    f"""{GEO}, e as (select *, case when ST_ABBREV='AS' then 'Renamed' else CNTY_NAME end county from geo
      where ST_ABBREV not in ('AF','AS') or (ST_ABBREV='AS' and P_CANCER >= 50))
    select ID, ST_ABBREV state, county, county record_county, 'Polygon' shape from e""",
)
def _(spark, sf):
    """All states are exported; then AS is with other rows and AF with none; a third export breaks."""
    folder, tracts, shapes = new_path(spark, "published"), tables.unit(spark, sf), tables.boundaries(spark, sf)
    jobs.publish_export(tracts, shapes, folder)
    changed = tracts.where("ST_ABBREV = 'AS' and P_CANCER >= 50").withColumn("CNTY_NAME", F.lit("Renamed"))
    jobs.publish_export(changed, shapes, folder, ["AS", "AF"])
    broken = tracts.where("ST_ABBREV in ('AM', 'AS')").withColumn("CNTY_NAME", F.raise_error(F.lit("broken export")).cast("string"))
    try:
        jobs.publish_export(broken, shapes, folder)
    except Exception as error:  # as any failure of a task, it leaves what is published
        if "broken export" not in str(error):
            raise
    features = readers.read_features(spark, f"{folder}/features", published=True)
    records = readers.read_keyed_json(spark, f"{folder}/tract-data", names.schema_for(["ID", "CNTY_NAME"]), published=True)
    return features.select("properties.ID", "state", F.col("properties.CNTY_NAME").alias("county"), F.col("geometry.type").alias("shape")).join(
        records.select("value.ID", F.col("value.CNTY_NAME").alias("record_county")), "ID"
    )


@query("optional_source", f"{UNIT} select ID, cast(null as double) RPL_EJI from unit")
def _(spark, sf):
    missing = readers.optional_source(spark, f"{sf}/no-such-index.csv", tables.NO_INDEX, lambda p: readers.read_indicators(spark, p))
    return joins.join_index(tables.unit(spark, sf), missing).select("ID", "RPL_EJI")


@query("write_csv", f"{UNIT} select cast(ID as varchar) ID, ST_ABBREV, CNTY_NAME from unit")
def _(spark, sf):
    path = new_path(spark, "csv")
    writers.write_csv(tables.unit(spark, sf).select("ID", "ST_ABBREV", "CNTY_NAME"), path)
    return spark.read.option("header", True).csv(path)


@query(
    "json_row",
    f"""{UNIT} select ID, concat('{{"ID":', ID, ',"ST_ABBREV":"', ST_ABBREV, '","CNTY_NAME":',
    coalesce('"' || CNTY_NAME || '"', 'null'), ',"high":', coalesce(cast(P_CANCER >= 50 as varchar), 'null'),
    ',"P_PTRAF":', coalesce(cast(cast(floor(P_PTRAF) as bigint) as varchar), 'null'), '}}') record from unit""",
)
def _(spark, sf):
    rows = tables.unit(spark, sf).select(
        "ID", "ST_ABBREV", "CNTY_NAME", (F.col("P_CANCER") >= 50).alias("high"), F.floor("P_PTRAF").alias("P_PTRAF")
    )
    return rows.select("ID", scalars.json_row(*rows.columns).alias("record"))


@query(
    "last_by_key",
    """select o_custkey, o_orderkey, o_totalprice, o_orderpriority from
    (select *, row_number() over (partition by o_custkey order by o_orderkey desc) rn from orders) where rn=1""",
)
def _(spark, sf):
    rows = tables.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return writers.last_by_key(rows, "o_custkey", "o_orderkey")


@query("fips_table", f"{UNIT} select substr(lpad(cast(ID as varchar),11,'0'),1,2) fips, max(ST_ABBREV) ST_ABBREV from unit group by 1")
def _(spark, sf):
    return writers.fips_table(tables.unit(spark, sf))


_menu = ", ".join(f"('indicator', {i}, '{k}', '{v}')" for i, (k, v) in enumerate(names.INDICATOR_LABELS.items(), 1))


@query(
    "manifest",
    f"""{UNIT} select 'state' kind, cast(row_number() over (order by v) as int) "position", v "value", cast(null as varchar) "label"
    from (select distinct ST_ABBREV v from unit where ST_ABBREV is not null)
    union all select * from (values {_menu}) t(kind, "position", "value", "label")""",
)
def _(spark, sf):
    return writers.manifest(tables.unit(spark, sf))


@query(
    "write_report",
    f"""{UNIT}, s as (select ST_ABBREV, count(*) n from unit where ST_ABBREV is not null group by 1)
    select ST_ABBREV, cast(sum(n) as bigint) tracts, count(*) states from s group by rollup(ST_ABBREV)""",
)
def _(spark, sf):
    return writers.write_report(tables.unit(spark, sf))


@query("require_columns", f"{UNIT} select ID, ST_ABBREV, {_r(['P_CANCER', 'P_RESP'])} from unit")
def _(spark, sf):
    needed = ["ID", "ST_ABBREV", "P_CANCER", "P_RESP"]
    return rounded(writers.require_columns(tables.unit(spark, sf), needed).select(*needed), needed[2:])


# ---- projection, filter, scalar ------------------------------------------------------------


@query("select_available", f"{UNIT} select {', '.join(names.MINIMAL_COLUMNS[:3])}, {_r(names.MINIMAL_COLUMNS[3:])} from unit")
def _(spark, sf):
    kept, _missing = select.select_available(tables.unit(spark, sf), [*names.MINIMAL_COLUMNS, "P_RSEI_AIR"])
    return rounded(kept, names.MINIMAL_COLUMNS[3:])


@query("numeric_columns", f"{UNIT} select {_r(['DEMOGIDX_2', *P_COLUMNS])} from unit")
def _(spark, sf):
    kept = select.numeric_columns(tables.unit(spark, sf))
    return rounded(kept, kept.columns)


@query("prefix_columns", f"{UNIT} select {_r(P_COLUMNS)} from unit")
def _(spark, sf):
    kept = select.prefix_columns(tables.unit(spark, sf), "P_")
    return rounded(kept, kept.columns)


@query("for_state", f"{UNIT} select ID, CNTY_NAME, {_r(['P_CANCER'])} from unit where ST_ABBREV='AS'")
def _(spark, sf):
    return rounded(select.for_state(tables.unit(spark, sf), "AS").select("ID", "CNTY_NAME", "P_CANCER"), ["P_CANCER"])


@query("for_states", f"{UNIT} select ID, ST_ABBREV, {_r(['P_PM25'])} from unit where ST_ABBREV in ('AM','MI')")
def _(spark, sf):
    return rounded(select.for_states(tables.unit(spark, sf), ["AM", "MI"]).select("ID", "ST_ABBREV", "P_PM25"), ["P_PM25"])


@query("for_states_default", f"{UNIT} select ID, ST_ABBREV from unit where ST_ABBREV in ('EU')")
def _(spark, sf):
    return select.for_states(tables.unit(spark, sf), [], ["EU"]).select("ID", "ST_ABBREV")


@query(
    "complete_cases",
    f"{UNIT} select ID, ST_ABBREV, {_r(['P_CANCER', 'P_RESP', 'P_DSLPM', 'P_PTRAF', 'DEMOGIDX_2'])} from unit where {sql.FIVE}",
)
def _(spark, sf):
    five = resilience.regression_columns()
    return rounded(select.complete_cases(tables.unit(spark, sf), five).select("ID", "ST_ABBREV", *five), five)


@query("drop_report", f"{UNIT} select count(*) n_before, count(*) filter ({sql.FIVE}) n_after, count(*) filter (not ({sql.FIVE})) n_dropped from unit")
def _(spark, sf):
    return select.drop_report(tables.unit(spark, sf), resilience.regression_columns())


@query("to_numeric_or_null", "select c_custkey, try_cast(case when c_custkey % 3 = 0 then c_name else cast(c_custkey as varchar) end as bigint) number from customer")
def _(spark, sf):
    key = F.col("c_custkey")
    source = F.when(key % 3 == 0, F.col("c_name")).otherwise(key.cast("string"))
    return tables.table(spark, sf, "customer").select(key, scalars.to_numeric_or_null(source).alias("number"))


_id_text = "case when ID % 3 = 0 then concat('US-', ID) when ID % 3 = 1 then concat(ID, '.00.99') else concat(' ', ID % 100000, 'x') end"


@query(
    "geoid11",
    f"""{UNIT}, d as (select ID, regexp_replace({_id_text}, '[^0-9]', '', 'g') t from unit)
    select ID, case when length(t) < 11 then lpad(t, 11, '0') else t end geoid11 from d""",
)
def _(spark, sf):
    id_ = F.col("ID")
    source = (
        F.when(id_ % 3 == 0, F.concat(F.lit("US-"), id_))
        .when(id_ % 3 == 1, F.concat(id_, F.lit(".00.99")))
        .otherwise(F.concat(F.lit(" "), id_ % 100000, F.lit("x")))
    )
    return tables.unit(spark, sf).select("ID", scalars.geoid11(source).alias("geoid11"))


@query("geoid11_int", f"{UNIT} select ID, lpad(cast(ID as varchar),11,'0') geoid11 from unit")
def _(spark, sf):
    # Read as a double, as a CSV reader may; the fraction must not add a digit.
    return tables.unit(spark, sf).select("ID", scalars.geoid11_int(F.col("ID").cast("double")).alias("geoid11"))


@query("state_fips", f"{UNIT} select ID, substr(lpad(cast(ID as varchar),11,'0'),1,2) fips from unit")
def _(spark, sf):
    return tables.unit(spark, sf).select("ID", scalars.state_fips(tables.geoid()).alias("fips"))


@query("tract_by_id", f"{UNIT} select {', '.join(BASE)}, {_r(P_COLUMNS)} from unit where ID = 1000000103")
def _(spark, sf):
    unit = tables.unit(spark, sf)
    return rounded(select.tract_by_id(unit, tables.fips(spark, sf), "01000000103").select(*BASE, *P_COLUMNS), P_COLUMNS)


@query("tracts_by_ids", f"{UNIT} select ID, ST_ABBREV, {_r(['P_CANCER'])} from unit where DEMOGIDX_2 > 0.5")
def _(spark, sf):
    unit = tables.unit(spark, sf)
    wanted = unit.where(F.col("DEMOGIDX_2") > 0.5).select(F.concat(F.lit("tract "), "ID").alias("id"))
    unknown = unit.select(F.concat(F.lit("99"), F.lpad(F.col("ID").cast("string"), 9, "0")).alias("id"))
    found = select.tracts_by_ids(unit, tables.fips(spark, sf), wanted.unionByName(unknown))
    return rounded(found.select("ID", "ST_ABBREV", "P_CANCER"), ["P_CANCER"])


@query(
    "drivers_for_tract",
    f"{DRIVERS} select lpad(cast(ID as varchar),11,'0') geoid11, ST_ABBREV, outcome, cast(rk as int) \"rank\", feature, shap from ranked where ID=1000000103 and ST_ABBREV='AF'",
)
def _(spark, sf):
    # Stored by state and sorted by id: one partition is read, with a pushed id filter.
    path = new_path(spark, "drivers-by-state")
    writers.write_tracts(drivers.top_drivers_wide(tables.contributions(spark, sf), tables.LINEAR_FEATURES), path)
    record = drivers.nest_drivers(select.drivers_for_tract(spark.read.parquet(path), "1000000103", "AF"))
    lists = [record.select("geoid11", "ST_ABBREV", F.lit(o).alias("outcome"), F.posexplode(o).alias("i", "d")) for o in ("cancer", "resp")]
    return lists[0].unionByName(lists[1]).select(
        "geoid11", "ST_ABBREV", "outcome", (F.col("i") + 1).alias("rank"), "d.feature", "d.shap"
    )


@query("label", f"{DRIVERS} select distinct feature, {labelled('feature', names.FEATURE_LABELS)} \"label\" from drv union all select distinct ST_ABBREV, ST_ABBREV from unit")
def _(spark, sf):
    long = drivers.to_long(tables.contributions(spark, sf), tables.LINEAR_FEATURES)
    features = long.select("feature").distinct().unionByName(tables.unit(spark, sf).select(F.col("ST_ABBREV").alias("feature")).distinct())
    return features.select("feature", scalars.label(F.col("feature")).alias("label"))


@query(
    "demographic_label",
    f"""{UNIT}, k as (select 'P_LOWINCPCT' "key", P_LOWINCPCT v from unit union all select 'P_PEOPCOLORPCT', P_PEOPCOLORPCT from unit
    union all select 'P_PM25', P_PM25 from unit) select "key", {labelled('"key"', names.DEMOGRAPHIC_LABELS)} "label", count(v) n from k group by 1, 2""",
)
def _(spark, sf):
    long = ranks.melt(tables.unit(spark, sf), [], ["P_LOWINCPCT", "P_PEOPCOLORPCT", "P_PM25"])
    return long.groupBy(F.col("variable").alias("key"), scalars.demographic_label(F.col("variable")).alias("label")).agg(F.count("*").alias("n"))


def _section_rows() -> str:
    cells = []
    for section, keys in names.SECTIONS.items():
        for position, key in enumerate(keys, 1):
            if key in BASE:
                shown = f"coalesce(cast({key} as varchar), '—')"
            elif key == "DEMOGIDX_2" or key in P_COLUMNS:
                v = f"round({key},3)"
                shown = f"case when {key} is null then '—' else {plain(v)} end"
            else:
                continue
            title = " ".join(w[:1].upper() + w[1:] for w in key.split("_"))
            cells.append(
                f"select ID, '{section}' section, {position} \"position\", '{key}' field, '{title}' title, {shown} \"value\" from unit"
            )
    return " union all ".join(cells)


@query("tract_sections", f"{UNIT} {_section_rows()}")
def _(spark, sf):
    return select.tract_sections(rounded(tables.unit(spark, sf), ["DEMOGIDX_2", *P_COLUMNS], 3))


@query(
    "format_key",
    f"""{UNIT}, k as (select distinct unnest(['P_CANCER','DEMOGIDX_2', lower(ST_ABBREV) || '_top_driver', STATE_NAME]) "key" from unit)
    select "key", array_to_string(list_transform(string_split(replace("key",'_',' '),' '), lambda x: upper(x[1]) || x[2:]), ' ') title from k""",
)
def _(spark, sf):
    keys = F.array(F.lit("P_CANCER"), F.lit("DEMOGIDX_2"), F.concat(F.lower("ST_ABBREV"), F.lit("_top_driver")), F.col("STATE_NAME"))
    found = tables.unit(spark, sf).select(F.explode(keys).alias("key")).distinct()
    return found.select("key", scalars.format_key(F.col("key")).alias("title"))


@query(
    "format_value",
    f"""{UNIT} select ID, case when P_PTRAF is null then '—' else {plain('round(P_PTRAF,4)')} end ptraf, case when P_PWDIS is null then '—' else {plain('round(floor(P_PWDIS),1)')} end pwdis from unit""",
)
def _(spark, sf):
    return tables.unit(spark, sf).select(
        "ID",
        scalars.format_value(F.round("P_PTRAF", 4)).alias("ptraf"),
        scalars.format_value(F.floor("P_PWDIS").cast("double")).alias("pwdis"),
    )


@query("fixed", f"{UNIT} select ID, coalesce({fixed1('P_PTRAF')}, '—') one, coalesce({fixed1('P_CANCER', 0)}, 'N/A') zero from unit")
def _(spark, sf):
    return tables.unit(spark, sf).select(
        "ID", scalars.fixed(F.col("P_PTRAF"), 1).alias("one"), scalars.fixed(F.col("P_CANCER"), 0, "N/A").alias("zero")
    )


@query("location_label", f"{UNIT} select ID, concat_ws(' · ', STATE_NAME, ST_ABBREV, CNTY_NAME, cast(ID as varchar)) location from unit")
def _(spark, sf):
    parts = [F.col(c) for c in ("STATE_NAME", "ST_ABBREV", "CNTY_NAME", "ID")]
    return tables.unit(spark, sf).select("ID", scalars.location_label(*parts).alias("location"))


@query("county_or_unknown", f"{UNIT} select ID, coalesce(CNTY_NAME, 'Unknown') county from unit")
def _(spark, sf):
    return tables.unit(spark, sf).select("ID", scalars.county_or_unknown(F.col("CNTY_NAME")).alias("county"))


_SCALE = """scale as (select lo, case when lo=hi then lo+1 else hi end hi from
  (select coalesce(min(P_PTRAF),0) lo, coalesce(max(P_PTRAF),1) hi from unit)),
m as (select ID, P_PTRAF v, lo, (lo+hi)/2 mid, hi from unit, scale)"""


def _ramp_sql() -> str:
    hexes = []
    for i in range(3):
        a, b, c = (int(colour[1 + 2 * i : 3 + 2 * i], 16) for colour in aggregates.RAMP)
        hexes.append(
            f"printf('%02x', cast(round(case when v < mid then {a}.0+({b - a}.0)*((v-lo)/(mid-lo)) else {b}.0+({c - b}.0)*((v-mid)/(hi-mid)) end) as int))"
        )
    return " || ".join(hexes)


@query("choropleth", f"{UNIT}, {_SCALE} select ID, case when v is not null then '#' || {_ramp_sql()} end colour from m")
def _(spark, sf):
    return aggregates.choropleth(tables.unit(spark, sf), "P_PTRAF").select("ID", "colour")


# ---- joins ---------------------------------------------------------------------------------


@query("join_geometry", f"{GEO} select ID, ST_ABBREV, ID GEOID, {_r(['P_CANCER'])} from geo")
def _(spark, sf):
    return rounded(_with_geometry(spark, sf).select("ID", "ST_ABBREV", "GEOID", "P_CANCER"), ["P_CANCER"])


@query(
    "join_index",
    f"""{INDEX} select lpad(cast(ID as varchar),11,'0') GEOID, ID, ST_ABBREV, {_r(['P_CANCER', 'RPL_EJI'])}
    from unit left join idx on trim(idx.GEOID)=lpad(cast(ID as varchar),11,'0')""",
)
def _(spark, sf):
    joined = joins.join_index(tables.unit(spark, sf), tables.index(spark, sf))
    return rounded(joined.select("GEOID", "ID", "ST_ABBREV", "P_CANCER", "RPL_EJI"), ["P_CANCER", "RPL_EJI"])


@query(
    "match_report",
    f"{INDEX} select count(RPL_EJI) matched, count(*) total from unit left join idx on trim(idx.GEOID)=lpad(cast(ID as varchar),11,'0')",
)
def _(spark, sf):
    return joins.match_report(joins.join_index(tables.unit(spark, sf), tables.index(spark, sf)))


@query("attach_ids", f"{DRIVERS} select u.ID, u.STATE_NAME, u.CNTY_NAME, shap_resp_P_PTRAF from unit u join contrib c on u.ID=c.ID")
def _(spark, sf):
    results = tables.contributions(spark, sf).select("ID", "shap_resp_P_PTRAF")
    return joins.attach_ids(results, tables.unit(spark, sf), ["STATE_NAME", "CNTY_NAME"])


@query(
    "attach_drivers",
    f"""{DRIVERS} select lpad(cast(u.ID as varchar),11,'0') geoid11, u.ST_ABBREV, c.feature first_cancer, c.shap first_shap
    from unit u left join (select * from ranked where outcome='cancer' and rk=1) c on c.ID=u.ID""",
)
def _(spark, sf):
    joined = joins.attach_drivers(tables.unit(spark, sf), tables.driver_records(spark, sf))
    first = F.get("cancer", F.lit(0))
    return joined.select("geoid11", "ST_ABBREV", first["feature"].alias("first_cancer"), first["shap"].alias("first_shap"))


@query("join_geometry_bucketed", ORACLES["join_geometry"])
def _(spark, sf):
    joined = joins.join_geometry(tables.bucketed_unit(spark, sf), tables.bucketed_boundaries(spark, sf), "geoid11")
    return rounded(joined.select("ID", "ST_ABBREV", "GEOID", "P_CANCER"), ["P_CANCER"])


@query("join_index_bucketed", ORACLES["join_index"])
def _(spark, sf):
    joined = joins.join_index(tables.bucketed_unit(spark, sf), tables.bucketed_index(spark, sf), "geoid11")
    return rounded(joined.select("GEOID", "ID", "ST_ABBREV", "P_CANCER", "RPL_EJI"), ["P_CANCER", "RPL_EJI"])


@query("attach_drivers_bucketed", ORACLES["attach_drivers"])
def _(spark, sf):
    joined = joins.attach_drivers(tables.bucketed_unit(spark, sf), tables.bucketed_drivers(spark, sf), "geoid11")
    first = F.get("cancer", F.lit(0))
    return joined.select("geoid11", "ST_ABBREV", first["feature"].alias("first_cancer"), first["shap"].alias("first_shap"))


@query(
    "attach_state",
    """select lpad(cast(cast(c_nationkey % 7 + 1 as bigint) * 1000000000 + c_custkey as varchar), 11, '0') geoid11,
    lpad(cast(c_nationkey % 7 + 1 as varchar), 2, '0') fips,
    case c_nationkey % 7 + 1 when 1 then 'AF' when 2 then 'AM' when 3 then 'AS' when 4 then 'EU' when 5 then 'MI' end ST_ABBREV from customer""",
)
def _(spark, sf):
    ids = tables.table(spark, sf, "customer").select(
        scalars.geoid11_int((F.col("c_nationkey") % 7 + 1).cast("bigint") * 1000000000 + F.col("c_custkey")).alias("geoid11")
    )
    return joins.attach_state(ids, tables.fips(spark, sf))


# ---- aggregations --------------------------------------------------------------------------

_DESCRIBED = ["DEMOGIDX_2", *P_COLUMNS]
_describe = " union all ".join(
    f"""select '{c}' variable, count({c}) "count", {r6(f'avg({c})')} mean, {r6(f'stddev_samp({c})')} std, {r6(f'min({c})')} "min",
    {r6(f'max({c})')} "max", {r6(f'quantile_cont({c},0.25)')} q25, {r6(f'quantile_cont({c},0.5)')} q50, {r6(f'quantile_cont({c},0.75)')} q75 from unit"""
    for c in _DESCRIBED
)


@query("describe", f"{UNIT} {_describe}")
def _(spark, sf):
    return rounded(aggregates.describe(tables.unit(spark, sf), _DESCRIBED), ["mean", "std", "min", "max", "q25", "q50", "q75"])


@query("county_summary", f"{COUNTY} select ST_ABBREV, county, tract_count, {_r(ROLLUP)} from county")
def _(spark, sf):
    return rounded(rollup.county_summary(tables.unit(spark, sf)), ROLLUP)


@query("state_summary", f"{COUNTY} select ST_ABBREV, tract_count, county_count, {_r(ROLLUP)} from state")
def _(spark, sf):
    return rounded(jobs.state_summaries(tables.unit(spark, sf)), ROLLUP)


def _frequency(keys: str, n: int) -> str:
    return f"""{DRIVERS}, freq as (select {keys}, outcome, feature, count(*) c from
      (select ST_ABBREV, coalesce(CNTY_NAME,'Unknown') county, outcome, feature, shap from ranked where rk<=3) where shap>0 group by all)
    select {keys}, outcome, feature, c "count", cast(rk as int) "rank" from
      (select *, row_number() over (partition by {keys}, outcome order by c desc, feature) rk from freq) where rk<={n}"""


@query("driver_frequency", _frequency("ST_ABBREV", 5))
def _(spark, sf):
    counts = rollup.driver_counts(tables.driver_records(spark, sf), ["ST_ABBREV"])
    return rollup.driver_frequency(counts, ["ST_ABBREV"])


@query("driver_frequency_by_county", _frequency("ST_ABBREV, county", 3))
def _(spark, sf):
    keys = ["ST_ABBREV", "county"]
    records = tables.driver_records(spark, sf).withColumn("county", scalars.county_or_unknown(F.col("CNTY_NAME")))
    return rollup.driver_frequency(rollup.driver_counts(records, keys), keys, 3)


_NESTED = f"""{DRIVERS}, {sql.COUNTY_TABLE},
rc as (select *, row_number() over (partition by ST_ABBREV order by round((P_CANCER+P_RESP)/2,9) desc, county) rk from county),
hit as (select ST_ABBREV, coalesce(CNTY_NAME,'Unknown') county, outcome, feature from ranked where rk<=3 and shap>0),
cf as (select *, row_number() over (partition by ST_ABBREV, county, outcome order by c desc, feature) fr from
  (select ST_ABBREV, county, outcome, feature, count(*) c from hit group by all)),
sf as (select *, row_number() over (partition by ST_ABBREV, outcome order by c desc, feature) fr from
  (select ST_ABBREV, outcome, feature, count(*) c from hit group by all)),
cl as (select ST_ABBREV, county, string_agg(feature || ':' || c, ',' order by fr) filter (outcome='cancer' and fr<=3) lc,
  string_agg(feature || ':' || c, ',' order by fr) filter (outcome='resp' and fr<=3) lr from cf group by all),
sl as (select ST_ABBREV, string_agg(feature || ':' || c, ',' order by fr) filter (outcome='cancer' and fr<=5) lc,
  string_agg(feature || ':' || c, ',' order by fr) filter (outcome='resp' and fr<=5) lr from sf group by all)"""


@query(
    "nested_summary",
    f"""{_NESTED} select rc.ST_ABBREV, s.tract_count, county_count, {r6('s.P_CANCER')} avg_cancer, {r6('s.P_PM25')} env_pm25, {r6('s.P_LOWINCPCT')} demo_lowinc,
    coalesce(sl.lc,'') top_cancer, coalesce(sl.lr,'') top_resp, cast(rc.rk as int) "rank", rc.county, rc.tract_count county_tracts, {r6('rc.P_RESP')} county_resp, {r6('rc.P_PM25')} county_pm25,
    coalesce(cl.lc,'') county_cancer_drivers, coalesce(cl.lr,'') county_resp_drivers
    from rc join state s on s.ST_ABBREV=rc.ST_ABBREV left join sl on sl.ST_ABBREV=rc.ST_ABBREV left join cl on cl.ST_ABBREV=rc.ST_ABBREV and cl.county=rc.county""",
)
def _(spark, sf):
    unit = tables.unit(spark, sf)
    counts = reports.county_driver_counts(unit, tables.driver_records(spark, sf))
    nested = rollup.nested_summary(rollup.county_summary(unit), counts)

    def shown(c: str):
        listed = F.transform(c, lambda d: F.concat(d["feature"], F.lit(":"), d["count"].cast("string")))
        return F.coalesce(F.array_join(listed, ","), F.lit(""))

    rows = nested.withColumn("c", F.explode("counties"))
    return rows.select(
        "ST_ABBREV", "tract_count", "county_count", r(F.col("avg_cancer")).alias("avg_cancer"), r(F.col("avg_env")["P_PM25"]).alias("env_pm25"),
        r(F.col("avg_demo")["P_LOWINCPCT"]).alias("demo_lowinc"), shown("top_cancer").alias("top_cancer"), shown("top_resp").alias("top_resp"),
        "c.rank", "c.county", F.col("c.tract_count").alias("county_tracts"), r(F.col("c.avg_resp")).alias("county_resp"),
        r(F.col("c.avg_env")["P_PM25"]).alias("county_pm25"), shown("c.top_cancer").alias("county_cancer_drivers"), shown("c.top_resp").alias("county_resp_drivers"),
    )


@query("distinct_states", f"{UNIT} select distinct ST_ABBREV from unit where ST_ABBREV is not null")
def _(spark, sf):
    return select.distinct_states(tables.unit(spark, sf))


@query("count_where", f"{UNIT} select ST_ABBREV, count(*) filter (P_CANCER>=80) high_cancer, count(*) filter (P_PTRAF is null) no_traffic from unit group by 1")
def _(spark, sf):
    flags = {"high_cancer": F.col("P_CANCER") >= 80, "no_traffic": F.col("P_PTRAF").isNull()}
    return aggregates.count_where(tables.unit(spark, sf), flags, ["ST_ABBREV"])


@query(
    "group_median",
    f"""{UNIT} select ST_ABBREV, 'DEMOGIDX_2' variable, {r6('median(DEMOGIDX_2)')} median from unit group by 1
    union all select ST_ABBREV, 'P_PTRAF', {r6('median(P_PTRAF)')} from unit group by 1""",
)
def _(spark, sf):
    return rounded(ranks.group_median(tables.unit(spark, sf), ["DEMOGIDX_2", "P_PTRAF"], ["ST_ABBREV"]), ["median"])


@query(
    "group_quartile_large",
    f"""{UNIT} select ST_ABBREV, 'DEMOGIDX_2' variable, {r6('quantile_cont(DEMOGIDX_2,0.75)')} median from unit group by 1
    union all select ST_ABBREV, 'P_PTRAF', {r6('quantile_cont(P_PTRAF,0.75)')} from unit group by 1""",
)
def _(spark, sf):
    # Every group takes the way of large ones: brackets, then ranks inside them.
    found = ranks.group_median(tables.unit(spark, sf), ["DEMOGIDX_2", "P_PTRAF"], ["ST_ABBREV"], 0.75, small=0)
    return rounded(found, ["median"])


@query(
    "indicator_scale",
    f"""{UNIT}, s as (select ST_ABBREV, coalesce(min(P_PTRAF),0) lo, coalesce(max(P_PTRAF),1) hi from unit group by 1)
    select ST_ABBREV, {r6('lo')} low, {r6('case when lo=hi then lo+1 else hi end')} high, {r6('(lo+case when lo=hi then lo+1 else hi end)/2')} mid from s""",
)
def _(spark, sf):
    return rounded(aggregates.indicator_scale(tables.unit(spark, sf), "P_PTRAF", ["ST_ABBREV"]), ["low", "high", "mid"])


_POINTS = """with p as (select label, vec_id, embedding e, unnest(range(0, cast(len(embedding)/2 as int))) i from embeddings),
q as (select label, cast(e[2*i+1] as double) x, cast(e[2*i+2] as double) y from p where vec_id % 4 in (1,2) or (vec_id % 4 = 0 and i = 0))"""


@query("bounds", f"{_POINTS} select label, {r6('min(x)')} min_lng, {r6('min(y)')} min_lat, {r6('max(x)')} max_lng, {r6('max(y)')} max_lat from q group by 1")
def _(spark, sf):
    return rounded(aggregates.bounds(tables.shapes(spark, sf), ["label"]), ["min_lng", "min_lat", "max_lng", "max_lat"])


@query("bounds_all", f"{_POINTS} select {r6('min(x)')} min_lng, {r6('min(y)')} min_lat, {r6('max(x)')} max_lng, {r6('max(y)')} max_lat from q")
def _(spark, sf):
    return rounded(aggregates.bounds(tables.shapes(spark, sf)), ["min_lng", "min_lat", "max_lng", "max_lat"])


def _histogram(source: str, keys: str, bins: int) -> str:
    head = f"{keys}, " if keys else ""
    on = " and ".join(f"g.{k.strip()}=h.{k.strip()}" for k in keys.split(",")) + " and " if keys else ""
    using = f"using ({keys})" if keys else "on true"
    cols = ", ".join(f"g.{k.strip()}" for k in keys.split(",")) + ", " if keys else ""
    return f"""{source},
e0 as (select {head} min(v) lo, max(v) hi from h0 where v is not null {f"group by {keys}" if keys else ""}),
e as (select {head} case when lo=hi then lo-0.5 else lo end lo, case when lo=hi then hi+0.5 else hi end hi from e0),
h as (select {head} least(cast(floor((v-lo)/((hi-lo)/{bins})) as int), {bins - 1}) bin, count(*) n from h0 join e {using} where v is not null group by all),
g as (select *, unnest(range({bins})) bin from e)
select {cols} cast(g.bin as int) bin, {r6(f"lo+g.bin*((hi-lo)/{bins})", 9)} bin_start, {r6(f"lo+(g.bin+1)*((hi-lo)/{bins})", 9)} bin_end, coalesce(n,0) n
from g left join h on {on} g.bin=h.bin"""


@query(
    "histogram",
    _histogram(f"{UNIT}, h0 as (select ST_ABBREV, coalesce(P_CANCER>=50, false) flag, round(DEMOGIDX_2,6) v from unit)", "ST_ABBREV, flag", 40),
)
def _(spark, sf):
    rows = tables.unit(spark, sf).select(
        "ST_ABBREV", F.coalesce(F.col("P_CANCER") >= 50, F.lit(False)).alias("flag"), F.round("DEMOGIDX_2", 6).alias("v")
    )
    return rounded(aggregates.histogram(rows, "v", 40, ["ST_ABBREV", "flag"]), ["bin_start", "bin_end"], 9)


@query("histogram_all", _histogram(f"{UNIT}, h0 as (select P_RESP v from unit)", "", 50))
def _(spark, sf):
    return rounded(aggregates.histogram(tables.unit(spark, sf), "P_RESP", 50), ["bin_start", "bin_end"], 9)


@query("driver_importance", f"{DRIVERS} select outcome, feature, {r6('avg(abs(shap))', 5)} mean_abs_shap from drv group by 1,2")
def _(spark, sf):
    long = drivers.to_long(tables.contributions(spark, sf), tables.LINEAR_FEATURES)
    return rounded(drivers.driver_importance(long), ["mean_abs_shap"], 5)


@query(
    "pivot_importance",
    f"""{DRIVERS} select feature, {r6("avg(abs(shap)) filter (outcome='cancer')", 5)} cancer, {r6("avg(abs(shap)) filter (outcome='resp')", 5)} resp from drv group by 1""",
)
def _(spark, sf):
    long = drivers.to_long(tables.contributions(spark, sf), tables.LINEAR_FEATURES)
    return rounded(drivers.pivot_importance(drivers.driver_importance(long)), ["cancer", "resp"], 5)


@query(
    "fit_r2",
    f"""{UNIT}, b as (select ST_ABBREV, P_CANCER y, P_RESP p, avg(P_CANCER) over (partition by ST_ABBREV) my from unit where P_CANCER is not null and P_RESP is not null)
    select ST_ABBREV, count(*) n, {r6('1-sum((y-p)*(y-p))/sum((y-my)*(y-my))')} r2, {r6('corr(y,p)*corr(y,p)')} r2_pearson from b group by 1""",
)
def _(spark, sf):
    return rounded(aggregates.fit_r2(tables.unit(spark, sf), "P_CANCER", "P_RESP", ["ST_ABBREV"]), ["r2", "r2_pearson"])


@query("union_states", f"{UNIT} select ID, ST_ABBREV, case when ST_ABBREV<>'EU' then CNTY_NAME end CNTY_NAME from unit where ST_ABBREV in ('AF','AM','EU')")
def _(spark, sf):
    unit = tables.unit(spark, sf)
    parts = [select.for_state(unit, st).select("ID", "ST_ABBREV", "CNTY_NAME") for st in ("AF", "AM")]
    return select.union_states([*parts, select.for_state(unit, "EU").select("ID", "ST_ABBREV")])


# ---- windows, sorts, top-k -------------------------------------------------------------------

_RANKED = f"{COUNTY}, rc as (select *, (P_CANCER+P_RESP)/2 risk, row_number() over (partition by ST_ABBREV order by round((P_CANCER+P_RESP)/2,9) desc, county) rk from county)"


@query("rank_counties", f"{_RANKED} select ST_ABBREV, county, {r6('risk')} risk, cast(rk as int) \"rank\" from rc")
def _(spark, sf):
    ranked = rollup.rank_counties(rollup.county_summary(tables.unit(spark, sf)))
    return rounded(ranked.select("ST_ABBREV", "county", "risk", "rank"), ["risk"])


@query("split_top", f"{_RANKED} select ST_ABBREV, county, cast(rk as int) \"rank\", rk<=3 detailed from rc")
def _(spark, sf):
    ranked = rollup.rank_counties(rollup.county_summary(tables.unit(spark, sf)))
    return rollup.split_top(ranked, 3).select("ST_ABBREV", "county", "rank", "detailed")


@query("top_drivers", f"{DRIVERS} select ID, outcome, feature, shap, cast(rk as int) \"rank\" from ranked where rk<=3")
def _(spark, sf):
    long = drivers.to_long(tables.contributions(spark, sf), tables.LINEAR_FEATURES, ["ID"])
    return drivers.top_drivers(long, ["ID"])


_top_wide = ", ".join(
    f"max(case when outcome='{o}' and rk={k} then {c} end) top_{o}_{k}_{c}" for o in ("cancer", "resp") for k in (1, 2, 3) for c in ("feature", "shap")
)


@query("top_drivers_wide", f"{DRIVERS} select ID, {_top_wide} from ranked group by ID")
def _(spark, sf):
    wide = drivers.top_drivers_wide(tables.contributions(spark, sf), tables.LINEAR_FEATURES)
    return wide.select("ID", *drivers.top_columns())


@query(
    "nest_drivers",
    f"""{DRIVERS} select lpad(cast(ID as varchar),11,'0') geoid11, ST_ABBREV, outcome, cast(rk as int) "rank", feature, shap from ranked where rk<=3""",
)
def _(spark, sf):
    records = tables.driver_records(spark, sf)
    parts = [records.select("geoid11", "ST_ABBREV", F.lit(o).alias("outcome"), F.posexplode(o).alias("i", "d")) for o in ("cancer", "resp")]
    return parts[0].unionByName(parts[1]).select("geoid11", "ST_ABBREV", "outcome", (F.col("i") + 1).alias("rank"), "d.feature", "d.shap")


@tables._once("loadings")
def _loadings(spark, sf):
    return stage(pca.pca(tables.unit(spark, sf), P_COLUMNS, ["ST_ABBREV"]), "loadings")


def _component_sql(columns) -> str:
    """Stand-ins that SQL can make: a column's row of the correlation matrix is a component's
    loadings, its share of the total variance what the component explains."""
    present = " and ".join(f"{c} is not null" for c in columns)
    total = "+".join(f"var_pop({c})" for c in columns)
    rows = " union all ".join(
        f"select ST_ABBREV, count(*) n, {i} pc, {r6(f'var_pop({a})/({total})', 9)} ve, '{b}' variable, {r6(f'corr({a},{b})', 9)} loading from cc group by 1"
        for i, a in enumerate(columns, 1)
        for b in columns
    )
    return f"{UNIT}, cc as (select * from unit where {present}), ld as ({rows}), cp as (select distinct ST_ABBREV, n, pc, ve from ld)"


def _components(spark, sf):
    found = moments.group_moments(tables.unit(spark, sf), _NARROW, ["ST_ABBREV"])
    number = F.array_position(F.array(*[F.lit(c) for c in _NARROW]), F.col("var1")).cast("int")
    own = found.where("var1 = var2")
    total = own.groupBy("ST_ABBREV").agg(F.sum("comoment").alias("total"))
    share = own.join(total, "ST_ABBREV").select("ST_ABBREV", "var1", r(F.col("comoment") / F.col("total"), 9).alias("var_explained"))
    rho = moments.correlations(found, ["ST_ABBREV"]).join(share, ["ST_ABBREV", "var1"])
    return rho.select("ST_ABBREV", "n", number.alias("pc"), "var_explained", F.col("var2").alias("variable"), r(F.col("rho"), 9).alias("loading"))


_NARROW = ["P_CANCER", "P_RESP", "P_DSLPM", "P_PTRAF", "P_PWDIS"]
_tops = ", ".join(f"max(variable) filter (rk={i}) top{i}_var" for i in range(1, 11))


@query(
    "top_loadings",
    f"""{_component_sql(_NARROW)}, od as (select *, row_number() over (partition by ST_ABBREV, pc order by abs(loading) desc, variable) rk from ld)
    select ST_ABBREV, n, cast(pc as int) pc, {r6('ve')} var_explained, {_tops} from od group by ST_ABBREV, n, pc, ve""",
)
def _(spark, sf):
    return rounded(pca.top_loadings(_components(spark, sf), ["ST_ABBREV"]), ["var_explained"])


@query(
    "rank_states",
    f"""{RESILIENCE} select ST_ABBREV, n_tracts, n_resilient_cancer, n_resilient_resp, r2_cancer, r2_resp, {r6('(r2_cancer+r2_resp)/2')} r2_avg,
    round_even(n_resilient_cancer/n_tracts*100, 1) pct_resilient_cancer, round_even(n_resilient_resp/n_tracts*100, 1) pct_resilient_resp
    from summ where r2_cancer is not null and r2_resp is not null""",
)
def _(spark, sf):
    ranked = resilience.rank_states(_summary(spark, sf))
    return rounded(ranked, ["r2_avg", "r2_cancer", "r2_resp"])


@query(
    "top_states",
    f"""{RESILIENCE} select ST_ABBREV, n_tracts, r2_cancer, r2_resp, {r6('(r2_cancer+r2_resp)/2')} r2_avg
    from summ where r2_cancer is not null and r2_resp is not null order by (r2_cancer+r2_resp)/2 desc, ST_ABBREV limit 15""",
)
def _(spark, sf):
    ranked = resilience.top_states(resilience.rank_states(_summary(spark, sf)), "r2_avg")
    return rounded(ranked.select("ST_ABBREV", "n_tracts", "r2_cancer", "r2_resp", "r2_avg"), ["r2_cancer", "r2_resp", "r2_avg"])


@query(
    "cumulative_variance",
    f"""{_component_sql(_NARROW)} select ST_ABBREV, n, cast(pc as int) pc, {r6('ve')} var_explained,
    {r6('sum(ve) over (partition by ST_ABBREV order by pc)')} cumulative from cp""",
)
def _(spark, sf):
    components = _components(spark, sf).select("ST_ABBREV", "n", "pc", "var_explained").distinct()
    return rounded(pca.cumulative_variance(components, ["ST_ABBREV"]), ["var_explained", "cumulative"])


@query(
    "pad_components",
    f"""{_component_sql(_NARROW)}, s as (select ST_ABBREV, count(*) n_tracts from unit group by 1)
    select g.ST_ABBREV, n_tracts, cast(g.pc as int) pc, {r6('ve')} var_explained
    from (select *, unnest(range(1,21)) pc from s) g left join cp on cp.ST_ABBREV=g.ST_ABBREV and cp.pc=g.pc""",
)
def _(spark, sf):
    components = _components(spark, sf).select("ST_ABBREV", "n", "pc", "var_explained").distinct()
    states = tables.unit(spark, sf).groupBy("ST_ABBREV").agg(F.count("*").alias("n_tracts"))
    padded = pca.pad_components(components, states)
    return rounded(padded, ["var_explained"])


@query("preview", f"{UNIT} select ID, ST_ABBREV, {_r(['P_CANCER'])} from unit order by ID limit 15")
def _(spark, sf):
    return rounded(select.preview(tables.unit(spark, sf).select("ID", "ST_ABBREV", "P_CANCER"), 15, ["ID"]), ["P_CANCER"])


# ---- statistics and models ---------------------------------------------------------------------


def _spearman_sql(columns, keys: str, source: str = UNIT) -> str:
    present = " and ".join(f"{c} is not null" for c in columns)
    part = f"{keys}, " if keys else ""
    rank = ", ".join(
        f"rank() over (partition by {keys or '1'} order by {c}) + (count(*) over (partition by {part}{c}) - 1)/2.0 {c}" for c in columns
    )
    rows = " union all ".join(
        f"select {part}'{a}' var1, '{b}' var2, count(*) n, {r6(f'corr({a},{b})') if a != b else '1.0'} rho from rk {f'group by {keys}' if keys else ''}"
        for a in columns
        for b in columns
    )
    return f"{source}, cc as (select * from unit where {present}), rk as (select {part}{rank} from cc) {rows}"


_WIDE = [*P_COLUMNS[:10], "DEMOGIDX_2"]


@query("spearman", _spearman_sql(_NARROW, "ST_ABBREV"))
def _(spark, sf):
    return rounded(moments.spearman(tables.unit(spark, sf), _NARROW, ["ST_ABBREV"]), ["rho"])


@query("spearman_all", _spearman_sql(_WIDE, ""))
def _(spark, sf):
    return rounded(moments.spearman(tables.unit(spark, sf), _WIDE), ["rho"])


_LINES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("spearman_copies", _spearman_sql(_LINES, "l_returnflag", "with unit as (select * from lineitem)"))
def _(spark, sf):
    # Rows without a key of their own: most prices and discounts repeat.
    return rounded(moments.spearman(tables.table(spark, sf, "lineitem"), _LINES, ["l_returnflag"]), ["rho"])


def _moments_sql(columns, keys: str) -> str:
    present = " and ".join(f"{c} is not null" for c in columns)
    part = f"{keys}, " if keys else ""
    rows = " union all ".join(
        f"select {part}'{a}' var1, '{b}' var2, count(*) n, {r6(f'avg({a})')} mean1, {r6(f'avg({b})')} mean2, {r6(f'covar_pop({a},{b})', 5)} covariance from cc {f'group by {keys}' if keys else ''}"
        for i, a in enumerate(columns)
        for b in columns[i:]
    )
    return f"{UNIT}, cc as (select * from unit where {present}) {rows}"


def _covariances(found):
    covariance = r(F.col("comoment") / F.col("n"), 5).alias("covariance")
    return rounded(found, ["mean1", "mean2"]).select("ST_ABBREV", "var1", "var2", "n", "mean1", "mean2", covariance)


@query("group_moments", _moments_sql(_NARROW, "ST_ABBREV"))
def _(spark, sf):
    return _covariances(moments.group_moments(tables.unit(spark, sf), _NARROW, ["ST_ABBREV"]))


@query("group_moments_wide", _moments_sql(_WIDE, "ST_ABBREV"))
def _(spark, sf):
    return _covariances(moments.group_moments(tables.unit(spark, sf), _WIDE, ["ST_ABBREV"]))


_standard = ", ".join(
    f"{r6(f'({c}-avg({c}) over w)/case when stddev_pop({c}) over w=0 then 1 else stddev_pop({c}) over w end')} {c}" for c in _NARROW
)


@query(
    "standardise",
    f"{UNIT} select ID, ST_ABBREV, {_standard} from unit where {' and '.join(f'{c} is not null' for c in _NARROW)} window w as (partition by ST_ABBREV)",
)
def _(spark, sf):
    rows = select.complete_cases(tables.unit(spark, sf).select("ID", "ST_ABBREV", *_NARROW))
    return rounded(moments.standardise(rows, _NARROW, ["ST_ABBREV"]), _NARROW)


def _rebuilt(loadings, keys, columns):
    """The correlation matrix put together again from all components: a complete check of both."""
    pair = F.explode(F.col("vector")).alias("v1", "x1")
    entries = F.map_from_entries(F.collect_list(F.struct("variable", "loading"))).alias("vector")
    vectors = loadings.groupBy(*keys, "n", "pc", "var_explained").agg(entries)
    first = vectors.select(*keys, "n", "var_explained", "vector", pair)
    both = first.select(*keys, "n", "var_explained", "v1", "x1", F.explode("vector").alias("v2", "x2"))
    weight = F.col("var_explained") * F.lit(len(columns)) * F.col("x1") * F.col("x2")
    return both.groupBy(*keys, "n", F.col("v1").alias("var1"), F.col("v2").alias("var2")).agg(r(F.sum(weight)).alias("rho"))


def _correlation_sql(columns, keys: str) -> str:
    present = " and ".join(f"{c} is not null" for c in columns)
    part = f"{keys}, " if keys else ""
    group = f"group by {keys}" if keys else ""
    aggregates_ = ", ".join(f"corr({a},{b}) c_{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j)
    rows = " union all ".join(
        f"select {part}n, '{a}' var1, '{b}' var2, {r6(f'c_{min(i, j)}_{max(i, j)}')} rho from cm" for i, a in enumerate(columns) for j, b in enumerate(columns)
    )
    return f"{UNIT}, cm as (select {part}count(*) n, {aggregates_} from unit where {present} {group}) {rows}"


@query("pca", _correlation_sql(["DEMOGIDX_2", *P_COLUMNS], ""))
def _(spark, sf):
    columns = ["DEMOGIDX_2", *P_COLUMNS]
    return _rebuilt(pca.pca(tables.unit(spark, sf), columns), [], columns)


@query("pca_loadings_by_state", _correlation_sql(P_COLUMNS, "ST_ABBREV"))
def _(spark, sf):
    return _rebuilt(_loadings(spark, sf), ["ST_ABBREV"], P_COLUMNS)


@query(
    "pca_by_state",
    f"""{UNIT}, s as (select ST_ABBREV, count(*) filter (P_CANCER is not null and P_PTRAF is not null) n_tracts, abs(corr(P_CANCER,P_PTRAF)) rho from unit group by 1)
    select ST_ABBREV, n_tracts, cast(pc as int) PC, case pc when 1 then {r6('(1+rho)/2')} when 2 then {r6('(1-rho)/2')} end var_explained,
      case when pc <= 2 then 2 else 0 end named
    from (select *, unnest(range(1,21)) pc from s)""",
)
def _(spark, sf):
    # Two columns have a closed form; both load alike, so their order is left open.
    rows = pca.pca_by_state(tables.unit(spark, sf), ["P_CANCER", "P_PTRAF"])
    tops = F.array(*[F.col(f"top{i}_var") for i in range(1, 11)])
    named = F.size(F.array_intersect(tops, F.array(F.lit("P_CANCER"), F.lit("P_PTRAF"))))
    return rounded(rows, ["var_explained"]).select("ST_ABBREV", "n_tracts", "PC", "var_explained", named.alias("named"))


def _components_sql() -> str:
    """Grid of states and components; eigenvalues square up to the sum of all squared correlations."""
    present = " and ".join(f"{c} is not null" for c in P_COLUMNS)
    squares = " + ".join(f"{2 if i < j else 1} * pow(corr({a},{b}), 2)" for i, a in enumerate(P_COLUMNS) for j, b in enumerate(P_COLUMNS) if i <= j)
    return f"""{UNIT}, cm as (select ST_ABBREV, {r6(squares, 2)} squares from unit where {present} group by 1),
    s as (select ST_ABBREV, count(*) filter ({present}) n_tracts from unit group by 1)
    select s.ST_ABBREV, n_tracts, cast(pc as int) PC, case when pc <= {len(P_COLUMNS)} then 0.0 end gap,
      case when pc <= {len(P_COLUMNS)} then 10 else 0 end named, squares
    from (select *, unnest(range(1,21)) pc from s) s join cm on cm.ST_ABBREV = s.ST_ABBREV"""


@query("pca_by_state_all", _components_sql())
def _(spark, sf):
    """All percentile columns. ``gap`` is what R v - lambda v leaves of each component, R being the
    correlations and lambda the share of variance that the result states; ``named`` counts the variables that
    the result names and that are truly its largest; ``squares`` adds up the squared eigenvalues."""
    p, unit = len(P_COLUMNS), tables.unit(spark, sf)
    result = stage(pca.pca_by_state(unit), "components")
    loadings = _loadings(spark, sf)
    shares = result.select("ST_ABBREV", F.col("PC").alias("pc"), (F.col("var_explained") * p).alias("eigen"))
    rho = moments.correlations(moments.group_moments(unit, P_COLUMNS, ["ST_ABBREV"]), ["ST_ABBREV"])
    turned = rho.join(loadings.select("ST_ABBREV", "pc", F.col("variable").alias("var2"), "loading"), ["ST_ABBREV", "var2"])
    turned = turned.groupBy("ST_ABBREV", "pc", F.col("var1").alias("variable")).agg(F.sum(F.col("rho") * F.col("loading")).alias("turned"))
    left = turned.join(loadings, ["ST_ABBREV", "pc", "variable"]).join(shares, ["ST_ABBREV", "pc"])
    gaps = left.groupBy("ST_ABBREV", "pc").agg(r(F.max(F.abs(F.col("turned") - F.col("eigen") * F.col("loading"))), 4).alias("gap"))
    tops = [F.col(f"top{i}_var") for i in range(1, 11)]
    best = pca.top_loadings(loadings, ["ST_ABBREV"]).select("ST_ABBREV", "pc", F.array(*tops).alias("best"))
    squares = shares.groupBy("ST_ABBREV").agg(r(F.sum(F.col("eigen") * F.col("eigen")), 2).alias("squares"))
    named = F.size(F.array_intersect(F.array_compact(F.array(*tops)), F.coalesce("best", F.array().cast("array<string>"))))
    grid = result.withColumn("pc", F.col("PC")).join(gaps, ["ST_ABBREV", "pc"], "left").join(best, ["ST_ABBREV", "pc"], "left")
    return grid.join(squares, "ST_ABBREV").select("ST_ABBREV", "n_tracts", F.col("pc").alias("PC"), "gap", named.alias("named"), "squares")


_coefficients = "i_{o} intercept, ba_{o} b1, bb_{o} b2, bc_{o} b3, r2_{o} r2"


def _ols_rows(prefix: str, keys: str) -> str:
    part = f"{keys}, " if keys else ""
    return f"{prefix} " + " union all ".join(
        f"select {part}'{c}' outcome, n, {r6(f'i_{o}', 4)} intercept, {r6(f'ba_{o}')} b1, {r6(f'bb_{o}')} b2, {r6(f'bc_{o}', 4)} b3, {r6(f'r2_{o}')} r2 from fit"
        for o, c in names.OUTCOME_COLUMNS.items()
    )


def _flat_ols(fits, *keys):
    b = F.col("coefficients")
    return fits.select(
        *keys, "outcome", "n", r(F.col("intercept"), 4).alias("intercept"), r(b[0]).alias("b1"), r(b[1]).alias("b2"),
        r(b[2], 4).alias("b3"), r(F.col("r2")).alias("r2"),
    )


@query("ols", _ols_rows(OLS_ALL, ""))
def _(spark, sf):
    # The single-model rule: rows complete in every numeric column.
    unit = tables.unit(spark, sf)
    rows = select.complete_cases(unit, select.numeric_names(unit))
    return _flat_ols(moments.ols(rows, list(names.OUTCOME_COLUMNS.values()), names.REGRESSION_PREDICTORS))


@query("ols_by_state", _ols_rows(OLS, "ST_ABBREV"))
def _(spark, sf):
    fits = moments.ols(tables.unit(spark, sf), list(names.OUTCOME_COLUMNS.values()), names.REGRESSION_PREDICTORS, ["ST_ABBREV"])
    return _flat_ols(fits, "ST_ABBREV")


@tables._once("models")
def _models(spark, sf):
    return stage(resilience.ols_by_state(tables.unit(spark, sf)), "ols")


@tables._once("resilience")
def _resilience(spark, sf):
    return stage(resilience.resilience(tables.unit(spark, sf), _models(spark, sf)), "resilience")


def _summary(spark, sf):
    return resilience.resilience_summary(_resilience(spark, sf), _models(spark, sf))


_FIT = ["P_CANCER", "P_RESP", "P_CANCER_pred", "P_RESP_pred", "resid_cancer", "resid_resp"]


@query(
    "resilience",
    f"""{RESILIENCE} select ID, ST_ABBREV, CNTY_NAME, {_r(['DEMOGIDX_2'])}, {_r(_FIT, 4)}, high_vulnerability, resilient_cancer, resilient_resp,
    lpad(cast(ID as varchar),11,'0') geoid11 from res""",
)
def _(spark, sf):
    rows = resilience.resilience(tables.unit(spark, sf), _models(spark, sf))
    return rounded(rounded(rows, _FIT, 4), ["DEMOGIDX_2"])


@query("resilience_summary", f"{RESILIENCE} select * from summ")
def _(spark, sf):
    return rounded(_summary(spark, sf), ["r2_cancer", "r2_resp"], 4)


@query(
    "stratified_sample",
    f"""{UNIT}, s as (select ST_ABBREV, count(*) size from unit group by 1),
    t as (select ST_ABBREV, size*120/cast(sum(size) over () as double) x from s),
    b as (select ST_ABBREV, x, cast(floor(x) as bigint) base from t),
    q as (select ST_ABBREV, base + case when row_number() over (order by x-base desc, ST_ABBREV) <= 120-sum(base) over () then 1 else 0 end n from b),
    d as (select ID, ST_ABBREV, row_number() over (partition by ST_ABBREV order by substr(md5(cast(ID as varchar)),1,15), ID) rn from unit)
    select ID, d.ST_ABBREV from d join q on q.ST_ABBREV=d.ST_ABBREV where rn <= n""",
)
def _(spark, sf):
    # A digest that both engines have, so that the drawn tracts are compared.
    draw = F.conv(F.substring(F.md5(F.col("ID").cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")
    return stratified_sample(tables.unit(spark, sf), 120, draw=draw).select("ID", "ST_ABBREV")


@tables._once("explained")
def explained(spark, sf):
    minimal = jobs.analysis_minimal(tables.unit(spark, sf), tables.whole_index(spark, sf))
    wide, models = jobs.explain_outcomes(minimal)
    return stage(wide, "explained"), models


def _features(wide):
    return [c.removeprefix("shap_cancer_") for c in wide.columns if c.startswith("shap_cancer_")]


_EXPLAINED = f"""{sql.WHOLE_INDEX}, cc as (select unit.* from unit join idx on trim(idx.GEOID)=lpad(cast(ID as varchar),11,'0')
  where {' and '.join(f'{c} is not null' for c in names.MINIMAL_COLUMNS)})"""


_fitted = " union all ".join(f"select ID, '{o}' outcome, {r6(c)} actual, 0.0 gap from cc" for o, c in names.OUTCOME_COLUMNS.items())


@query("fit_outcome", f"{_EXPLAINED} select ID, outcome, actual, cast(gap as double) gap from ({_fitted})")
def _(spark, sf):
    """Of each tract, how far the prediction of the model's stored leaf table, scored by expressions alone, is from the model's."""
    wide, models = explained(spark, sf)
    parts = []
    for fitted in models:
        leaves = stage(boosting.leaf_rows(spark, fitted), "leaves")
        gap = F.abs(boosting.leaf_score(leaves, fitted.features) - F.col(f"pred_{fitted.outcome}"))
        actual = r(F.col(names.OUTCOME_COLUMNS[fitted.outcome])).alias("actual")
        parts.append(wide.select("ID", F.lit(fitted.outcome).alias("outcome"), actual, r(gap).alias("gap")))
    return parts[0].unionByName(parts[1])


_zero = " union all ".join("select ID, '{o}' outcome, 0.0 gap from cc".format(o=o) for o in names.OUTCOME_COLUMNS)


@query("tree_shap_fitted", f"{_EXPLAINED} select ID, outcome, cast(gap as double) gap, cast(0 as double) mean_gap from ({_zero})")
def _(spark, sf):
    """What a fitted model's contributions leave open: of prediction minus mean prediction for each
    tract, and of zero for each feature's mean over the background."""
    wide, _models = explained(spark, sf)
    features = _features(wide)
    means = wide.agg(*[F.avg(f"pred_{o}").alias(o) for o in names.OUTCOME_COLUMNS]).head()
    parts = []
    for o in names.OUTCOME_COLUMNS:
        total = sum((F.col(f"shap_{o}_{f}") for f in features), F.lit(0.0))
        worst = wide.agg(r(F.greatest(*[F.abs(F.avg(f"shap_{o}_{f}")) for f in features])).alias("w")).head().w
        parts.append(
            wide.select("ID", F.lit(o).alias("outcome"), r(total - (F.col(f"pred_{o}") - F.lit(means[o]))).alias("gap"), F.lit(worst).alias("mean_gap"))
        )
    return parts[0].unionByName(parts[1])


# A tree by hand over two features, with the values of its four leaves for each outcome: the left
# side splits the second feature at 30, the right side at 60.
_TREE = {"cancer": (1.0, 4.0, -2.0, 7.0), "resp": (0.5, -3.0, 2.5, 6.0)}
_SPLIT = ["P_DSLPM", "P_PTRAF"]


def _hand_leaves(values) -> boosting.LeafTable:
    inf = float("inf")
    low = np.array([[-inf, -inf], [-inf, 30.0], [50.0, -inf], [50.0, 60.0]])
    high = np.array([[50.0, 30.0], [50.0, inf], [inf, 60.0], [inf, inf]])
    return boosting.LeafTable(np.array(values), np.array([[0, 1]] * 4), low, high)


def _tree_sql(values, a: str, b: str) -> str:
    return f"case when {a} <= 50 then case when {b} <= 30 then {values[0]} else {values[1]} end else case when {b} <= 60 then {values[2]} else {values[3]} end end"


def _shapley_sql() -> str:
    """Both features' Shapley values against each of the background's cells, by their shares."""
    parts = []
    for o, values in _TREE.items():
        f = lambda a, b: _tree_sql(values, f"{a}.x", f"{b}.y")  # noqa: B023, E731
        first = f"sum(w*(({f('u', 'u')})-({f('b', 'u')})+({f('u', 'b')})-({f('b', 'b')})))/2"
        second = f"sum(w*(({f('u', 'u')})-({f('u', 'b')})+({f('b', 'u')})-({f('b', 'b')})))/2"
        parts += [f"{first} shap_{o}_{_SPLIT[0]}", f"{second} shap_{o}_{_SPLIT[1]}"]
    return f"""{UNIT}, u as (select ID, ST_ABBREV, CNTY_NAME, P_DSLPM x, P_PTRAF y from unit where P_DSLPM is not null and P_PTRAF is not null),
    b as (select case when x <= 50 then 0 else 100 end x, case when y <= 30 then 0 when y <= 60 then 45 else 100 end y,
      count(*) / (select count(*) from u) w from u group by 1, 2),
    phi as (select ID, {", ".join(parts)} from u, b group by ID)"""


_shaps = [f"shap_{o}_{c}" for o in _TREE for c in _SPLIT]


@tables._once("hand-explained")
def _hand_explained(spark, sf):
    rows = select.complete_cases(tables.unit(spark, sf).select("ID", "ST_ABBREV", "CNTY_NAME", *_SPLIT), _SPLIT)
    models = [boosting.OutcomeModel(o, _SPLIT) for o in _TREE]
    return stage(boosting.tree_shap(rows, models, leaves=[_hand_leaves(v) for v in _TREE.values()]), "hand-explained")


@query("tree_shap", f"{_shapley_sql()} select ID, {_r(_shaps)} from phi")
def _(spark, sf):
    return rounded(_hand_explained(spark, sf).select("ID", *_shaps), _shaps)


_importance = " union all ".join(
    f"select '{c}' feature, {', '.join(r6(f'avg(abs(shap_{o}_{c}))') + ' ' + o for o in _TREE)} from phi" for c in _SPLIT
)


@query("shap_importance", f"{_shapley_sql()} {_importance}")
def _(spark, sf):
    long = drivers.to_long(_hand_explained(spark, sf), _SPLIT, ["ID"])
    return rounded(drivers.pivot_importance(drivers.driver_importance(long)), list(_TREE))


_left = " union all ".join(
    f"select ID, '{o}' outcome, {r6(c, 4)} actual, {r6(f'{c}_pred', 4)} predicted, {r6(f'resid_{o}', 4)} residual from res"
    for o, c in names.OUTCOME_COLUMNS.items()
)


@query("residual_table", f"{RESILIENCE} {_left}")
def _(spark, sf):
    """Of the least-squares predictions, which SQL has as well."""
    rows = _resilience(spark, sf).withColumnsRenamed({f"{c}_pred": f"pred_{o}" for o, c in names.OUTCOME_COLUMNS.items()})
    return rounded(boosting.residuals(rows, list(names.OUTCOME_COLUMNS), ["ID"]), ["actual", "predicted", "residual"], 4)


@query(
    "analysis_minimal",
    f"""{INDEX} select lpad(cast(ID as varchar),11,'0') GEOID, {', '.join(names.MINIMAL_COLUMNS[:3])}, {_r(names.MINIMAL_COLUMNS[3:])}, {_r(['RPL_EJI'])}
    from unit left join idx on trim(idx.GEOID)=lpad(cast(ID as varchar),11,'0')
    where {' and '.join(f'{c} is not null' for c in names.MINIMAL_COLUMNS)}""",
)
def _(spark, sf):
    rows = jobs.analysis_minimal(tables.unit(spark, sf), tables.index(spark, sf))
    return rounded(rows, [*names.MINIMAL_COLUMNS[3:], "RPL_EJI"])


@query("export", f"{GEO}, s as (select ST_ABBREV, count(*) n from geo group by 1) select ST_ABBREV, cast(sum(n) as bigint) tracts, count(*) states from s group by rollup(ST_ABBREV)")
def _(spark, sf):
    return jobs.export(tables.unit(spark, sf), tables.boundaries(spark, sf), new_path(spark, "export"))


@query(
    "export_records",
    """select lpad(cast(cast(n_regionkey+1 as bigint)*1000000000 + o_custkey as varchar),11,'0') geoid11, n, o_orderkey, price, 4 columns from
    (select o_custkey, n_regionkey, o_orderkey, cast(o_totalprice as double) price, count(*) over (partition by o_custkey) n,
      row_number() over (partition by o_custkey order by o_orderkey desc) rn
     from orders join customer on c_custkey=o_custkey join nation on n_nationkey=c_nationkey) where rn=1""",
)
def _(spark, sf):
    """A CSV with a row per order: the last row of a customer is the record that is kept."""
    path, folder = new_path(spark, "orders-csv"), new_path(spark, "export")
    home = tables.table(spark, sf, "customer").join(tables.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    orders = tables.table(spark, sf, "orders").join(home, F.col("c_custkey") == F.col("o_custkey"))
    rows = orders.select(
        ((F.col("n_regionkey") + 1).cast("bigint") * 1000000000 + F.col("o_custkey")).alias("ID"),
        F.concat(F.lit("S"), "n_regionkey").alias("ST_ABBREV"), "o_orderkey", F.col("o_totalprice").alias("price"),
    )
    writers.write_csv(rows.orderBy("o_orderkey"), path)
    source = readers.read_indicators(spark, path, position=True)
    areas = source.select(scalars.geoid11_int(F.col("ID")).alias("GEOID")).distinct()
    point = F.struct(F.lit("Point").alias("type"), F.lit("[1,2]").alias("coordinates"))
    jobs.export(source, areas.withColumn("geometry", point), folder)
    text_rows = readers.read_keyed_json(spark, f"{folder}/tract-data", T.MapType(T.StringType(), T.StringType()))
    times = source.groupBy(scalars.geoid11_int(F.col("ID")).alias("geoid11")).agg(F.count("*").alias("n"))
    kept = F.map_filter("value", lambda k, v: k != "GEOID")
    return text_rows.join(times, "geoid11").select(
        "geoid11", "n", F.col("value")["o_orderkey"].cast("bigint").alias("o_orderkey"), F.col("value")["price"].cast("double").alias("price"),
        F.size(kept).alias("columns"),
    )


# ---- text --------------------------------------------------------------------------------------


@query("strip_html", f"select page_id, {sql.STRIPPED} body from pages")
def _(spark, sf):
    return tables.table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("body"))


@query(
    "truncate_text",
    f"""with t as (select page_id, {sql.STRIPPED} body from pages)
    select page_id, case when length(body) > 12000 then concat(substr(body,1,12000), chr(10), chr(10), '[Content truncated.]') else body end body from t""",
)
def _(spark, sf):
    body = text.strip_html(F.col("html"))
    return tables.table(spark, sf, "pages").select("page_id", text.truncate_text(body).alias("body"))


@query(
    "unwrap_fence",
    """with f as (select conv_id, turn, trim(case when turn % 4 = 0 then concat('```markdown', chr(10), text, chr(10), '```')
      when turn % 4 = 1 then concat('Here it is:', chr(10), '```', chr(10), text, chr(10), '```', chr(10), 'Regards') else concat('  ', text, chr(10)) end, concat(' ', chr(9), chr(10), chr(13))) t from conversations)
    select conv_id, turn, case when regexp_matches(t, '(?m)^```(?:markdown|md)?\\s*\\n?((?s:.*?))\\n?```\\s*$')
      then trim(regexp_extract(t, '(?m)^```(?:markdown|md)?\\s*\\n?((?s:.*?))\\n?```\\s*$', 1), concat(' ', chr(9), chr(10), chr(13))) else t end body from f""",
)
def _(spark, sf):
    turn = F.col("turn")
    fenced = (
        F.when(turn % 4 == 0, F.concat(F.lit("```markdown\n"), "text", F.lit("\n```")))
        .when(turn % 4 == 1, F.concat(F.lit("Here it is:\n```\n"), "text", F.lit("\n```\nRegards")))
        .otherwise(F.concat(F.lit("  "), "text", F.lit("\n")))
    )
    return tables.table(spark, sf, "conversations").select("conv_id", "turn", text.unwrap_fence(fenced).alias("body"))


@query(
    "result_blocks",
    f"""with r as (select regexp_extract(url,'//([^/]+)',1) query, page_id "position", concat('Page ', page_id) title, url,
      case when page_id % 5 <> 0 then {sql.STRIPPED} end txt, case when page_id % 2 = 0 then [concat('no ', page_id), url] else [] end highlights from pages),
    k as (select *, row_number() over (partition by query order by "position") i from r),
    c as (select *, coalesce(substr(txt,1,1500), array_to_string(highlights,' '), '') body from k where i<=8),
    g as (select query, string_agg(concat('[', i, '] ', title, chr(10), 'URL: ', url, chr(10), case when length(body)=0 then '(No content)' else body end), concat(chr(10),chr(10)) order by i) t from c group by 1),
    q as (select distinct query from r union select distinct lang from documents)
    select q.query, case when t is null then concat('[No web results for: "', q.query, '". Proceed with other context.]')
      else concat('Web search results for "', q.query, '":', chr(10), chr(10), t) end context from q left join g on g.query=q.query""",
)
def _(spark, sf):
    pages = tables.table(spark, sf, "pages")
    page = F.col("page_id")
    results = pages.select(
        F.regexp_extract("url", "//([^/]+)", 1).alias("query"),
        page.alias("position"),
        F.concat(F.lit("Page "), page).alias("title"),
        "url",
        F.when(page % 5 != 0, text.strip_html(F.col("html"))).alias("text"),
        F.when(page % 2 == 0, F.array(F.concat(F.lit("no "), page), F.col("url"))).otherwise(F.array().cast(T.ArrayType(T.StringType()))).alias("highlights"),
    )
    asked = results.select("query").unionByName(tables.table(spark, sf, "documents").select(F.col("lang").alias("query")))
    return reports.result_blocks(results, asked)


def _tracts(spark, sf, digits: int | None = None):
    unit = tables.unit(spark, sf)
    if digits is not None:
        unit = rounded(unit, P_COLUMNS, digits)
    return joins.attach_drivers(unit, tables.driver_records(spark, sf))


def _optional_line(prefix: str, column: str) -> str:
    return f"case when {column} is not null then concat('{prefix}', {plain(f'round({column},3)')}) end"


def _labels_of(outcome: str) -> str:
    shown = labelled("feature", names.FEATURE_LABELS)
    return f"string_agg({shown}, ', ' order by rk) filter (outcome='{outcome}' and shap>0 and rk<=3)"


_tract_lines = ", ".join(
    [
        "concat('Census tract: ', u.ID, ' (', coalesce(u.ST_ABBREV,''), ', ', coalesce(u.CNTY_NAME,''), ')')",
        "''",
        f"'{reports.DEMOGRAPHICS_TITLE}'",
        *[_optional_line(f"  {label}: ", c) for c, label in names.DEMOGRAPHIC_LABELS.items()],
        "''",
        f"'{reports.ENVIRONMENT_TITLE}'",
        *[_optional_line(f"  {c}: ", c) for c in names.ENVIRONMENT_COLUMNS],
        "''",
        f"'{reports.OUTCOMES_TITLE}'",
        *[_optional_line(reports.OUTCOME_LINES[o], c) for o, c in names.OUTCOME_COLUMNS.items()],
        "''",
        f"case when d.ID is null then '{reports.NO_DRIVERS}' else '{reports.DRIVERS_TITLE}' end",
        "concat('  Cancer risk: ', nullif(lc,''))",
        "concat('  Respiratory risk: ', nullif(lr,''))",
        f"case when d.ID is not null and lc is null and lr is null then '{reports.NO_INCREASE}' end",
    ]
)
_tract_lines = _tract_lines.replace("concat('  Cancer risk: ', nullif(lc,''))", "case when lc is not null then concat('  Cancer risk: ', lc) end").replace(
    "concat('  Respiratory risk: ', nullif(lr,''))", "case when lr is not null then concat('  Respiratory risk: ', lr) end"
)


@query(
    "tract_context",
    f"""{DRIVERS}, d as (select ID, {_labels_of('cancer')} lc, {_labels_of('resp')} lr from ranked group by ID)
    select u.ID, array_to_string(list_filter([{_tract_lines}], lambda x: x is not null), chr(10)) context from unit u left join d on d.ID=u.ID""",
)
def _(spark, sf):
    return reports.tract_context(_tracts(spark, sf, 3)).select("ID", "context")


def _popup(outcome: str) -> str:
    shown = labelled("feature", names.FEATURE_LABELS)
    return f"string_agg({shown} || ' increases risk', '|' order by rk) filter (outcome='{outcome}' and shap>0 and rk<=3)"


@query(
    "increasing_drivers",
    f"""{DRIVERS}, d as (select ID, {_popup('cancer')} lc, {_popup('resp')} lr from ranked group by ID)
    select u.ID, case when d.ID is null then '{reports.POPUP_NO_DRIVERS}' else coalesce(lc, '{reports.POPUP_NO_INCREASE}') end cancer,
      case when d.ID is null then '{reports.POPUP_NO_DRIVERS}' else coalesce(lr, '{reports.POPUP_NO_INCREASE}') end resp
    from unit u left join d on d.ID=u.ID""",
)
def _(spark, sf):
    rows = reports.increasing_drivers(_tracts(spark, sf))
    return rows.select("ID", *[F.array_join(f"{o}_increasing", "|").alias(o) for o in ("cancer", "resp")])


_STATE_TEXT = f"""{DRIVERS}, {sql.COUNTY_TABLE},
rc as (select *, row_number() over (partition by ST_ABBREV order by round((P_CANCER+P_RESP)/2,9) desc, county) rk from county),
hit as (select ST_ABBREV, coalesce(CNTY_NAME,'Unknown') county, outcome, feature, {labelled("feature", names.FEATURE_LABELS)} lab from ranked where rk<=3 and shap>0),
cf as (select *, row_number() over (partition by ST_ABBREV, county, outcome order by c desc, feature) fr from
  (select ST_ABBREV, county, outcome, feature, lab, count(*) c from hit group by all)),
sf as (select *, row_number() over (partition by ST_ABBREV, outcome order by c desc, feature) fr from
  (select ST_ABBREV, outcome, feature, lab, count(*) c from hit group by all)),
cl as (select ST_ABBREV, county, string_agg(lab, ', ' order by fr) filter (outcome='cancer' and fr<=3) lc,
  string_agg(lab, ', ' order by fr) filter (outcome='resp' and fr<=3) lr from cf group by all),
sl as (select ST_ABBREV, string_agg(concat(lab,' (',c,' tracts)'), ', ' order by fr) filter (outcome='cancer' and fr<=5) lc,
  string_agg(concat(lab,' (',c,' tracts)'), ', ' order by fr) filter (outcome='resp' and fr<=5) lr from sf group by all),
lines as (select rc.ST_ABBREV, rc.rk, array_to_string(list_filter([
  concat('### ', rc.county, ' (', tract_count, ' tracts)'),
  concat('- Avg cancer risk: ', {fixed1('P_CANCER')}, ' | Avg respiratory risk: ', {fixed1('P_RESP')}),
  concat('- Low-income: ', {fixed1('P_LOWINCPCT')}, ' | People of color: ', {fixed1('P_PEOPCOLORPCT')}),
  case when lc is not null then concat('- Top cancer drivers: ', lc) end,
  case when lr is not null then concat('- Top respiratory drivers: ', lr) end, ''], lambda x: x is not null), chr(10)) t
  from rc left join cl on cl.ST_ABBREV=rc.ST_ABBREV and cl.county=rc.county where rk<=15),
body as (select ST_ABBREV, string_agg(t, chr(10) order by rk) t from lines group by 1)
select s.ST_ABBREV, array_to_string(list_filter([
  concat('# State: ', s.ST_ABBREV), concat('Total tracts: ', tract_count, ' | Counties: ', county_count), '',
  '{reports.STATE_AVERAGES_TITLE}', concat('- Cancer risk: ', {fixed1('P_CANCER')}), concat('- Respiratory risk: ', {fixed1('P_RESP')}),
  concat('- Low-income population: ', {fixed1('P_LOWINCPCT')}), concat('- People of color: ', {fixed1('P_PEOPCOLORPCT')}), '',
  '{reports.STATE_DRIVERS_TITLE}', case when lc is not null then concat('- Cancer: ', lc) end, case when lr is not null then concat('- Respiratory: ', lr) end, '',
  '## Top 15 Highest-Risk Counties (by average cancer + respiratory risk)', '', t], lambda x: x is not null), chr(10)) context
from state s left join sl on sl.ST_ABBREV=s.ST_ABBREV left join body on body.ST_ABBREV=s.ST_ABBREV"""


@query("state_context", _STATE_TEXT)
def _(spark, sf):
    return reports.state_context(tables.unit(spark, sf), tables.driver_records(spark, sf))


# 23 counties per state, so that eight of them are in the compact part.
_MANY = _STATE_TEXT.replace("select ID, ST_ABBREV, STATE_NAME, CNTY_NAME, DEMOGIDX_2,", "select ID, ST_ABBREV, STATE_NAME, concat('County ', ID % 23) CNTY_NAME, DEMOGIDX_2,", 1).replace(
    "body as (select",
    f"""compact as (select rc.ST_ABBREV, concat('{reports.OTHER_COUNTIES_TITLE}', chr(10), chr(10), string_agg(concat('- ', rc.county, ': ', tract_count, ' tracts, cancer ',
  {fixed1('P_CANCER', 0)}, ', resp ', {fixed1('P_RESP', 0)}, ', top driver: ', coalesce(string_split(lc, ', ')[1], string_split(lr, ', ')[1], '—')), chr(10) order by rk), chr(10)) more
  from rc left join cl on cl.ST_ABBREV=rc.ST_ABBREV and cl.county=rc.county where rk>15 group by 1),
body as (select""",
    1,
).replace("'', t], lambda", "'', t, more], lambda", 1) + " left join compact on compact.ST_ABBREV=s.ST_ABBREV"


@query("state_context_many_counties", _MANY)
def _(spark, sf):
    unit = tables.unit(spark, sf).withColumn("CNTY_NAME", F.concat(F.lit("County "), (F.col("ID") % 23).cast("string")))
    return reports.state_context(unit, tables.driver_records(spark, sf))
