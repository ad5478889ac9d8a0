"""Compare two results the way the check does: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math


def _plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = sorted(tuple(_plain(row[i]) for i in order) for row in rows)
    return [columns[i] for i in order], plain


def difference(spark_df, relation) -> str | None:
    """None if equal, else a short description."""
    left = rows_of(spark_df.columns, spark_df.collect())
    right = rows_of(list(relation.columns), relation.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows != {len(right[1])} rows"
    odd = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(odd)} rows differ, first {odd[0]}" if odd else None
