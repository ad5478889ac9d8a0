"""Column expressions over GeoJSON geometries (type plus coordinates as JSON text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_POSITION = "array<double>"


def points(geometry: Column) -> Column:
    """Every position of a Point, Polygon or MultiPolygon as one array; other types give none.

    The text is parsed once, into a variant, and read at the depth of its type.
    """
    kind = geometry["type"]

    def positions(parsed: Column) -> Column:
        at = lambda depth: F.try_variant_get(parsed, "$", f"{'array<' * depth}{_POSITION}{'>' * depth}")
        return (
            F.when(kind == "Point", F.array(at(0)))
            .when(kind == "Polygon", F.flatten(at(2)))
            .when(kind == "MultiPolygon", F.flatten(F.flatten(at(3))))
        )

    # A list of one variant, so that the parse is one expression for all types.
    every = F.get(F.transform(F.array(F.try_parse_json(geometry["coordinates"])), positions), 0)
    usable = lambda p: (F.size(p) >= 2) & F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull()
    return F.filter(every, usable)
