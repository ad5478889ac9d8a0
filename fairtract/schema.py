"""Names, labels and types of the tract tables.

Everything in this module is a fixed value: column lists, labels and codes
that outputs must reproduce exactly.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Columns that identify a tract rather than describe it.
ID_COLUMNS = [
    "OID_",
    "ID",
    "STATE_NAME",
    "ST_ABBREV",
    "CNTY_NAME",
    "Shape_Length",
    "Shape_Area",
]

# Properties kept on each map feature.
FEATURE_COLUMNS = [
    "ID",
    "ST_ABBREV",
    "CNTY_NAME",
    "P_PM25",
    "P_OZONE",
    "P_DSLPM",
    "P_CANCER",
    "P_RESP",
    "P_RSEI_AIR",
    "P_PTRAF",
    "P_LDPNT",
    "P_PNPL",
    "P_PRMP",
    "P_PTSDF",
    "P_UST",
    "P_PWDIS",
    "P_LOWINCPCT",
    "P_PEOPCOLORPCT",
]

# Map indicators and their labels, in menu order.
INDICATOR_LABELS = {
    "P_PM25": "PM 2.5",
    "P_OZONE": "Ozone",
    "P_DSLPM": "Diesel PM",
    "P_CANCER": "Cancer Risk",
    "P_RESP": "Respiratory Hazard",
    "P_RSEI_AIR": "RSEI Air",
    "P_PTRAF": "Traffic Proximity",
    "P_LDPNT": "Lead Paint",
    "P_PNPL": "NPL Sites",
    "P_PRMP": "RMP Facilities",
    "P_PTSDF": "TSDF Proximity",
    "P_UST": "UST Proximity",
    "P_PWDIS": "Wastewater Discharge",
    "P_LOWINCPCT": "Low Income %",
    "P_PEOPCOLORPCT": "People of Color %",
}

# Columns of the minimal analysis set.
MINIMAL_COLUMNS = [
    "ID",
    "ST_ABBREV",
    "CNTY_NAME",
    "P_CANCER",
    "P_RESP",
    "P_PM25",
    "P_OZONE",
    "P_DSLPM",
    "P_PTRAF",
    "P_LDPNT",
    "P_PNPL",
    "P_PRMP",
    "P_PTSDF",
    "P_UST",
    "P_PWDIS",
    "DEMOGIDX_2",
]

# Columns taken from the second index.
INDEX_COLUMNS = [
    "GEOID",
    "RPL_EJI",
    "SPL_EJI",
    "RPL_SER",
    "RPL_SVM",
    "RPL_EBM",
    "RPL_EJI_CBM",
    "EPL_CANCER",
    "EPL_ASTHMA",
    "LOCATION",
]

# Environment indicators of the roll-ups and of the tract report.
ENVIRONMENT_COLUMNS = [
    "P_PM25",
    "P_OZONE",
    "P_DSLPM",
    "P_PTRAF",
    "P_LDPNT",
    "P_PNPL",
    "P_PRMP",
    "P_PTSDF",
    "P_UST",
    "P_PWDIS",
]
OUTCOME_COLUMNS = {"cancer": "P_CANCER", "resp": "P_RESP"}
ROLLUP_ENVIRONMENT = [*OUTCOME_COLUMNS.values(), *ENVIRONMENT_COLUMNS]
ROLLUP_DEMOGRAPHICS = ["P_LOWINCPCT", "P_PEOPCOLORPCT"]

# Features of the boosted-tree models.
MODEL_FEATURES = [
    *ENVIRONMENT_COLUMNS,
    "DEMOGIDX_2",
    "RPL_EJI",
    "RPL_SER",
    "RPL_SVM",
    "RPL_EBM",
    "RPL_EJI_CBM",
]

# Predictors of the least-squares models.
REGRESSION_PREDICTORS = ["P_DSLPM", "P_PTRAF", "DEMOGIDX_2"]

# Readable names of model features.
FEATURE_LABELS = {
    "P_PM25": "PM 2.5",
    "P_OZONE": "Ozone",
    "P_DSLPM": "Diesel PM",
    "P_PTRAF": "Traffic proximity",
    "P_LDPNT": "Lead paint",
    "P_PNPL": "NPL sites",
    "P_PRMP": "RMP facilities",
    "P_PTSDF": "TSDF proximity",
    "P_UST": "UST proximity",
    "P_PWDIS": "Wastewater discharge",
    "DEMOGIDX_2": "Demographic index (low income + minority)",
    "RPL_EJI": "EJI overall percentile",
    "RPL_SER": "EJI socioeconomic rank",
    "RPL_SVM": "EJI social vulnerability",
    "RPL_EBM": "EJI environmental burden",
    "RPL_EJI_CBM": "EJI climate burden",
}

# Readable names of the demographic percentiles.
DEMOGRAPHIC_LABELS = {
    "P_LOWINCPCT": "Low-income population (percentile)",
    "P_PEOPCOLORPCT": "People of color (percentile)",
}

# Sections of a tract record with their columns, in page order.
SECTIONS = {
    "Location": ["ID", "STATE_NAME", "ST_ABBREV", "CNTY_NAME", "REGION"],
    "Demographics": [
        "ACSTOTPOP", "ACSIPOVBAS", "ACSEDUCBAS", "ACSTOTHH", "ACSTOTHU",
        "ACSUNEMPBAS", "DEMOGIDX_2", "DEMOGIDX_5", "PEOPCOLOR",
        "PEOPCOLORPCT", "LOWINCOME", "LOWINCPCT", "UNEMPLOYED", "UNEMPPCT",
        "LINGISO", "LINGISOPCT", "LESSHS", "LESSHSPCT", "UNDER5",
        "UNDER5PCT", "OVER64", "OVER64PCT", "LIFEEXPPCT",
    ],
    "Environmental indicators (raw)": ["PM25", "OZONE", "DSLPM", "CANCER", "RESP", "RSEI_AIR", "PTRAF"],
    "Environmental indicators (percentiles)": [
        "P_PM25", "P_OZONE", "P_DSLPM", "P_CANCER", "P_RESP", "P_RSEI_AIR",
        "P_PTRAF", "P_LDPNT", "P_PNPL", "P_PRMP", "P_PTSDF", "P_UST",
        "P_PWDIS",
    ],
    "D2/D5 indices (demographic % in high exposure)": [
        "D2_PM25", "D5_PM25", "D2_OZONE", "D5_OZONE", "D2_DSLPM", "D5_DSLPM",
        "D2_CANCER", "D5_CANCER", "D2_RESP", "D5_RESP", "D2_RSEI_AIR",
        "D5_RSEI_AIR", "D2_PTRAF", "D5_PTRAF", "D2_LDPNT", "D5_LDPNT", "D2_PNPL",
        "D5_PNPL", "D2_PRMP", "D5_PRMP", "D2_PTSDF", "D5_PTSDF", "D2_UST",
        "D5_UST", "D2_PWDIS", "D5_PWDIS",
    ],
    "Other": [
        "PRE1960", "PRE1960PCT", "PNPL", "PRMP", "PTSDF", "UST", "PWDIS",
        "AREALAND", "AREAWATER", "NPL_CNT", "TSDF_CNT", "EXCEED_COUNT_80",
        "EXCEED_COUNT_80_SUP", "P_DEMOGIDX_2", "P_DEMOGIDX_5",
        "P_PEOPCOLORPCT", "P_LOWINCPCT", "P_UNEMPPCT", "P_LINGISOPCT",
        "P_LESSHSPCT", "P_UNDER5PCT", "P_OVER64PCT", "P_LIFEEXPPCT",
        "P_D2_PM25", "P_D5_PM25", "P_D2_OZONE", "P_D5_OZONE", "P_D2_DSLPM",
        "P_D5_DSLPM", "P_D2_CANCER", "P_D5_CANCER", "P_D2_RESP", "P_D5_RESP",
        "P_D2_RSEI_AIR", "P_D5_RSEI_AIR", "P_D2_PTRAF", "P_D5_PTRAF", "P_D2_LDPNT",
        "P_D5_LDPNT", "P_D2_PNPL", "P_D5_PNPL", "P_D2_PRMP", "P_D5_PRMP",
        "P_D2_PTSDF", "P_D5_PTSDF", "P_D2_UST", "P_D5_UST", "P_D2_PWDIS",
        "P_D5_PWDIS",
    ],
}

_TEXT_COLUMNS = {"STATE_NAME", "ST_ABBREV", "CNTY_NAME", "GEOID", "LOCATION"}
_WHOLE_COLUMNS = {"OID_", "ID", "REGION"}


def field(name: str) -> T.StructField:
    """Type of a known tract column; anything not listed is a double."""
    if name in _TEXT_COLUMNS:
        return T.StructField(name, T.StringType())
    if name in _WHOLE_COLUMNS:
        return T.StructField(name, T.LongType())
    return T.StructField(name, T.DoubleType())


def known_columns() -> list[str]:
    names = [*ID_COLUMNS, *(c for keys in SECTIONS.values() for c in keys)]
    return list(dict.fromkeys([*names, *FEATURE_COLUMNS, *INDEX_COLUMNS]))


def schema_for(names: list[str]) -> T.StructType:
    return T.StructType([field(name) for name in names])


GEOMETRY_SCHEMA = T.StructType(
    [T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]
)

DRIVER_LIST = T.ArrayType(
    T.StructType([T.StructField("feature", T.StringType()), T.StructField("shap", T.DoubleType())])
)
DRIVER_RECORD = T.StructType(
    [T.StructField("cancer", DRIVER_LIST), T.StructField("resp", DRIVER_LIST)]
)
