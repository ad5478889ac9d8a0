"""Tables stored in buckets of the padded tract id, so that they join without a shuffle.

Tables that are joined again and again are dealt over the same number of buckets by ``geoid11`` once, when
they are stored, and sorted within them. Joins by that column (``key="geoid11"`` in ``operators.joins``)
then read bucket by bucket. An id is in one row or a few, so no bucket is hot. Choose a number of
buckets at which one fits a task, as it stays with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairtract.functions.scalars import geoid11_int, to_numeric_or_null, zero_pad

KEY = "geoid11"


def by_number(c: str = "ID") -> Column:
    """The key of a numeric id, or of text that may hold none."""
    return geoid11_int(to_numeric_or_null(F.col(c)))


def by_text(c: str = "GEOID") -> Column:
    """The key of an id in text, blanks around it cut."""
    return zero_pad(F.trim(c))


def store(
    df: DataFrame, table: str, buckets: int, key: Column | None = None, path: str | None = None, keyless: bool = False
) -> DataFrame:
    """Write ``df`` as a table of that name, with the column ``geoid11`` from ``key`` where it has none, and read it.

    ``path`` keeps it out of the warehouse folder. An older table of the name is replaced. Rows without a key
    match nothing and would all be in one bucket; ``keyless`` keeps them, for the left side of a left join.
    """
    spark = df.sparkSession
    rows = df if key is None else df.withColumn(KEY, key)
    rows = rows if keyless else rows.where(F.col(KEY).isNotNull())
    # One task per bucket writes one file: as many files as buckets.
    writer = rows.repartition(buckets, KEY).write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY)
    if path:
        writer = writer.option("path", path)
    writer.format("parquet").saveAsTable(table)
    return spark.table(table)


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"drop table if exists `{table}`")
