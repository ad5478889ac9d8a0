"""The complete jobs: export, analysis chain and state summary, each over all states at once."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtract import schema as names
from fairtract.functions.scalars import geoid11_int, json_row, nan_to_null
from fairtract.operators import boosting, drivers, joins, pca, resilience, rollup, select
from fairtract.operators.sampling import stratified_sample
from fairtract.sources import publish, writers
from fairtract.sources.readers import POSITION
from fairtract.staging import scope, stage

STATE = "ST_ABBREV"


def export(indicators: DataFrame, geometry: DataFrame, folder: str, order: str | None = None) -> DataFrame:
    """Join tracts with boundaries and write features, keyed records, parquet, codes and manifest.

    ``order`` names the source position that decides between rows of one id,
    by default the one that ``read_indicators`` adds; it is not written. Records
    hold all other columns but the geometry. Returns the number of tracts
    written per state.
    """
    spark = indicators.sparkSession
    order = order or (POSITION if POSITION in indicators.columns else None)
    with scope(spark):
        joined = stage(joins.join_geometry(nan_to_null(indicators), geometry), "joined")
        kept = joined.drop("geometry")
        records = kept.drop(order) if order else kept
        writers.write_features(joined, f"{folder}/features")
        unique = writers.last_by_key(kept, "ID", order)
        keyed = unique.select(
            STATE, geoid11_int(F.col("ID")).alias("geoid11"), json_row(*records.columns).alias("record")
        )
        writers.write_keyed_json(keyed, f"{folder}/tract-data", "geoid11", F.col("record"))
        writers.write_tracts(records, f"{folder}/tracts")
        writers.fips_table(records).write.json(f"{folder}/state-fips")
        writers.manifest(records).write.json(f"{folder}/manifest")
        return _local(writers.write_report(joined))


def publish_export(
    indicators: DataFrame, geometry: DataFrame, folder: str, states: Sequence[str] = (), order: str | None = None
) -> dict[str, dict[str, str]]:
    """Export the states of ``indicators`` in the place of what the folder has of them; other states stay.

    Features and keyed records appear together, by one mark (see ``sources.publish``); read them with
    ``published=True``. ``states`` without tracts any more go.
    """
    spark = indicators.sparkSession
    order = order or (POSITION if POSITION in indicators.columns else None)
    with scope(spark):
        joined = stage(joins.join_geometry(nan_to_null(indicators), geometry), "joined")
        kept = joined.drop("geometry")
        records = kept.drop(order) if order else kept
        unique = writers.last_by_key(kept, "ID", order)
        keyed = unique.select(STATE, geoid11_int(F.col("ID")).alias("geoid11"), json_row(*records.columns).alias("record"))
        writes = {
            "features": lambda path: writers.write_features(joined, path),
            "tract-data": lambda path: writers.write_keyed_json(keyed, path, "geoid11", F.col("record")),
        }
        return publish.publish(spark, folder, writes, states)


def _local(report: DataFrame) -> DataFrame:
    """A table of one row per state that outlives the tables it was made from."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)


def analysis_minimal(indicators: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Complete rows of the minimal columns, with the second index where it is given, and the source position."""
    kept, _ = select.select_available(indicators, [*names.MINIMAL_COLUMNS, POSITION])
    rows = select.complete_cases(kept)
    if index is None:
        return rows
    second, _ = select.select_available(index, names.INDEX_COLUMNS)
    return joins.join_index(rows, second)


def state_summaries(tracts: DataFrame) -> DataFrame:
    """Weighted state means of all states."""
    return rollup.state_summary(rollup.county_summary(tracts))


def explain_outcomes(
    minimal: DataFrame, features: Sequence[str] = names.MODEL_FEATURES, max_fit_rows: int | None = None, **model
) -> tuple[DataFrame, list[boosting.OutcomeModel]]:
    """Fit both outcomes and add predictions, contributions and top drivers to every complete tract.

    ``max_fit_rows`` bounds the rows that the trees are fitted on, by a
    stratified sample; by default all are. Every complete tract is predicted
    and explained, against all of them as background.
    """
    rows, available, _ = boosting.model_data(minimal, features)
    rows = stage(rows, "model-rows")
    fitted_on = rows if max_fit_rows is None else stage(stratified_sample(rows, max_fit_rows), "fit-rows")
    outcomes = [o for o, column in names.OUTCOME_COLUMNS.items() if column in rows.columns]
    # Boosting runs many small jobs in sequence; the outcomes are fitted side by side.
    with ThreadPool(len(outcomes)) as pool:
        models = pool.map(lambda outcome: boosting.fit_outcome(fitted_on, available, outcome, **model), outcomes)
    out = rows
    for fitted in models:
        out = boosting.predict(out, fitted)
    out = boosting.tree_shap(out, models, rows)
    return drivers.top_drivers_wide(out, available), models


def analyse(indicators: DataFrame, index: DataFrame | None, folder: str, **options) -> DataFrame:
    """Every table of the analysis chain in one job: minimal set, components, resilience, drivers.

    Tables are written as CSV, driver records as keyed JSON per state.
    ``options`` go to ``explain_outcomes``. Returns the driver records per state.
    """
    spark = indicators.sparkSession
    wanted = {*names.MINIMAL_COLUMNS, *resilience.regression_columns(), resilience.VULNERABILITY, "ID", "CNTY_NAME", POSITION}
    columns = [c for c in indicators.columns if c in wanted or c.startswith("P_")]
    with scope(spark):
        # The raw table is read once; all steps read the stored columns.
        tracts = stage(indicators.select(*columns), "indicators")
        minimal = stage(analysis_minimal(tracts, index), "minimal")
        writers.write_csv(minimal.drop(POSITION), f"{folder}/analysis_minimal")
        writers.write_csv(pca.pca_by_state(tracts), f"{folder}/pca_by_state")
        models = stage(resilience.ols_by_state(tracts), "ols")
        found = stage(resilience.resilience(tracts, models), "resilience")
        writers.write_csv(found, f"{folder}/resilience_all_states")
        writers.write_csv(resilience.resilience_summary(found, models), f"{folder}/resilience_by_state")
        wide, fitted = explain_outcomes(minimal, **options)
        explained = stage(wide, "explained")
        writers.write_csv(explained.drop(POSITION), f"{folder}/tract_shap")
        long = drivers.to_long(explained, fitted[0].features)
        writers.write_csv(drivers.pivot_importance(drivers.driver_importance(long)), f"{folder}/shap_importance")
        last = writers.last_by_key(explained, "ID", POSITION if POSITION in explained.columns else None)
        records = drivers.nest_drivers(last)
        body = F.to_json(F.struct(*names.OUTCOME_COLUMNS))
        writers.write_keyed_json(records.withColumn("record", body), f"{folder}/shap", "geoid11", F.col("record"))
        return _local(writers.write_report(records))
