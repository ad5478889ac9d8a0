"""Column expressions: ids, labels and number formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtract.schema import DEMOGRAPHIC_LABELS, FEATURE_LABELS

GEOID_LENGTH = 11
MISSING = "—"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, so aggregates skip it."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, floats)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def to_numeric_or_null(c: Column) -> Column:
    return c.try_cast("bigint")


def zero_pad(c: Column, length: int = GEOID_LENGTH) -> Column:
    """Left-pad with zeros; longer text stays whole (``lpad`` alone would cut it)."""
    return F.when(F.length(c) < length, F.lpad(c, length, "0")).otherwise(c)


def geoid11(c: Column) -> Column:
    return zero_pad(F.regexp_replace(c.cast("string"), "[^0-9]", ""))


def geoid11_int(c: Column) -> Column:
    return zero_pad(c.cast("bigint").cast("string"))


def state_fips(geoid: Column) -> Column:
    return F.substring(geoid, 1, 2)


def _lookup(c: Column, labels: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c)


def label(feature: Column) -> Column:
    return _lookup(feature, FEATURE_LABELS)


def demographic_label(key: Column) -> Column:
    return _lookup(key, DEMOGRAPHIC_LABELS)


def format_key(c: Column) -> Column:
    """Underscores to spaces, first letter of each word upper, the rest as it is."""
    words = F.split(F.replace(c, F.lit("_"), F.lit(" ")), "(?<![A-Za-z0-9])(?=[A-Za-z0-9])")
    return F.array_join(
        F.transform(
            words,
            lambda w: F.when(
                w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
            ).otherwise(w),
        ),
        "",
    )


def format_value(c: Column) -> Column:
    """Missing as a dash, whole numbers bare, others to 4 decimals without trailing zeros."""
    trimmed = F.regexp_replace(F.format_string("%.4f", c), r"\.?0+$", "")
    return (
        F.when(c.isNull(), MISSING)
        .when(c == F.floor(c), c.cast("decimal(38,0)").cast("string"))
        .otherwise(trimmed)
    )


def fixed(c: Column, decimals: int, missing: str = MISSING) -> Column:
    usable = c.isNotNull() & ~F.isnan(c)
    return F.when(usable, F.format_string(f"%.{decimals}f", c)).otherwise(missing)


def plain_number(c: Column) -> Column:
    """Shortest decimal text of a double: no ``.0`` on whole numbers, no exponent."""

    def digits(scale: int) -> Column:
        return F.regexp_replace(c.try_cast(f"decimal(38,{scale})").cast("string"), r"\.?0+$", "")

    size = F.abs(c)
    return (
        F.when(c == 0, "0")
        .when(size.between(1, 1e20), digits(16))
        .when((size >= 1e-6) & (size < 1), digits(23))
        .otherwise(c.cast("string"))
    )


def location_label(*parts: Column, separator: str = " · ") -> Column:
    return F.concat_ws(separator, *[F.nullif(p.cast("string"), F.lit("")) for p in parts])


def county_or_unknown(c: Column) -> Column:
    return F.coalesce(c, F.lit("Unknown"))


def json_row(*columns: str) -> Column:
    """One JSON object; missing values appear as explicit nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
