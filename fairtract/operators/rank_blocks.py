"""Cross-products of ranks, with ranks moved as packed arrays.

Values of all columns are sorted by range together, as in ``ranks.rank_columns``. A slice, a bounded run of a sorted
partition, ranks its own values and packs them by blocks of rows: one row per slice, variable and block, not one per value. What
lies before a slice, and how far the values at its two ends reach into others, comes from a small table of slices.
Then the pieces of a block meet: they make its matrix of ranks, which leaves as sums of products of
ranks less their mean, known beforehand as (n + 1) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtract.staging import stage

#: Rows of a block; row numbers of one input partition are consecutive.
BLOCK_BITS = 16
#: Cells of a slice, which a task holds at once, and bits for the slices of one shuffle partition.
SLICE_CELLS = 1 << 20
SLICE_BITS = 32
_INSIDE, _LOW, _HIGH = 0, 1, 2


def _cells(numbered: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """``keys, variable (number of the column), value, row`` in slices that are sorted by group and value."""
    entries = F.array(*[F.struct(F.lit(i).alias("variable"), F.col(c).alias("value")) for i, c in enumerate(columns)])
    long = numbered.select(*keys, "row", F.explode(entries).alias("e")).select(*keys, "e.variable", "e.value", "row")
    order = ["variable", *keys, "value", "row"]
    return long.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id())


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches put together until they have ``most`` cells."""
    parts, cells = [], 0
    for batch in batches:
        parts.append(batch)
        cells += len(batch)
        if cells >= most:
            yield pa.Table.from_batches(parts)
            parts, cells = [], 0
    if cells:
        yield pa.Table.from_batches(parts)


def _pack(keys: list[str], schema: T.StructType, most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        # A shuffle partition may be of any size: it makes several slices, in its order.
        for number, table in enumerate(_runs(batches, most)):
            value, row = table["value"].to_numpy(), table["row"].to_numpy()
            value = value + 0.0  # one zero
            slice_ = (table["slice"][0].as_py() << SLICE_BITS) + number
            new = np.zeros(len(row), bool)
            new[0] = True
            for name in ["variable", *keys]:
                codes = table[name].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            begins = np.flatnonzero(new)
            for a, b in zip(begins, np.append(begins[1:], len(row))):
                group = {"slice": slice_, **{n: table[n][int(a)].as_py() for n in ["variable", *keys]}}
                rows = _pieces(value[a:b], row[a:b], group)
                for i in range(0, len(rows), 256):
                    yield from pa.Table.from_pylist(rows[i : i + 256], to_arrow_schema(schema)).to_batches()

    return pack


def _pieces(value: np.ndarray, row: np.ndarray, group: dict) -> list[dict]:
    """Packed ranks of one group of a slice by block, and a summary of its ends in the first piece."""
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    begins = np.flatnonzero(new)
    ties = np.diff(np.append(begins, len(value)))
    rank = np.repeat(begins + (ties + 1) / 2, ties)
    end = np.full(len(value), _INSIDE, np.int8)
    end[len(value) - ties[-1] :] = _HIGH
    end[: ties[0]] = _LOW
    block = row >> BLOCK_BITS
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    out = [
        {**group, "block": int(block[at[0]]), "place": (row[at] & ((1 << BLOCK_BITS) - 1)).astype("<u2").tobytes(), "rank": rank[at].astype("<f8").tobytes(), "end": end[at].tobytes()}
        for at in np.split(order, cuts)
    ]
    out[0] |= {"size": len(value), "first": float(value[0]), "n_first": int(ties[0]), "last": float(value[-1]), "n_last": int(ties[-1])}
    return out


def _ends(pieces: DataFrame, groups: list[str]) -> DataFrame:
    """Per slice and group: rows ``before`` it, the group's ``total``, and the ranks of its lowest and highest value."""
    spans = pieces.where("size is not null").select("slice", *groups, "size", "first", "n_first", "last", "n_last")
    along = Window.partitionBy(*groups).orderBy("slice")
    spans = spans.withColumn("before", F.sum("size").over(along) - F.col("size")).withColumn("total", F.sum("size").over(Window.partitionBy(*groups)))
    front = F.struct(F.col("first").alias("value"), F.col("n_first").alias("n"), F.col("before").alias("below"))
    back = F.struct(F.col("last").alias("value"), F.col("n_last").alias("n"), (F.col("before") + F.col("size") - F.col("n_last")).alias("below"))
    both = F.when(F.col("first") == F.col("last"), F.array(front)).otherwise(F.array(front, back))
    # The rows below a value end where its first slice has it.
    values = spans.select(*groups, F.explode(both).alias("e")).groupBy(*groups, F.col("e.value").alias("value"))
    values = values.agg((F.min("e.below") + (F.sum("e.n") + 1) / 2).alias("rank"))
    low = values.withColumnsRenamed({"value": "first", "rank": "low"})
    high = values.withColumnsRenamed({"value": "last", "rank": "high"})
    found = spans.join(low, [*groups, "first"]).join(high, [*groups, "last"])
    return found.select("slice", *groups, "before", "total", "low", "high")


def _products(keys: list[str], p: int):
    """Sums of products of centred ranks of one block."""
    left, right = np.triu_indices(p)

    def products(table: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, own in table.groupby(keys, sort=False) if keys else [((), table)]:
            x, total = np.full((1 << BLOCK_BITS, p), np.nan), int(own["total"].iloc[0])
            for piece in own.itertuples(index=False):
                rank = np.frombuffer(piece.rank, "<f8") + piece.before
                end = np.frombuffer(piece.end, np.int8)
                rank = np.where(end == _LOW, piece.low, np.where(end == _HIGH, piece.high, rank))
                x[np.frombuffer(piece.place, "<u2"), piece.variable] = rank - (total + 1) / 2
            x = x[~np.isnan(x[:, 0])]
            gram = x.T @ x
            key = key if isinstance(key, tuple) else (key,)
            block = {name: [value] * len(left) for name, value in zip(keys, key)}
            out.append(pd.DataFrame({**block, "n": total, "i": left, "j": right, "part": gram[left, right]}))
        return pd.concat(out)

    return products


def rank_moments(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``group_moments`` of the average ranks of complete rows, without rows whose key is missing."""
    columns, keys = list(columns), list(keys)
    usable = F.lit(True)
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    values = [F.col(c).cast("double").alias(c) for c in columns]
    numbered = stage(rows.where(usable).select(*keys, *values, F.monotonically_increasing_id().alias("row")), "numbered")
    groups = ["variable", *keys]
    fields = [T.StructField("slice", T.LongType()), T.StructField("variable", T.IntegerType()), *[numbered.schema[k] for k in keys]]
    packed = T.StructType([*fields, *T.StructType.fromDDL("block long, place binary, rank binary, end binary, size long, first double, n_first long, last double, n_last long").fields])
    pieces = stage(_cells(numbered, columns, keys).mapInArrow(_pack(keys, packed, SLICE_CELLS), packed), "pieces")
    placed = pieces.select("slice", *groups, "block", "place", "rank", "end").join(stage(_ends(pieces, groups), "ends"), ["slice", *groups])
    parts = T.StructType([*[numbered.schema[k] for k in keys], *T.StructType.fromDDL("n long, i int, j int, part double").fields])
    sums = placed.groupBy("block").applyInPandas(_products(keys, len(columns)), parts).groupBy(*keys, "n", "i", "j").agg(F.sum("part").alias("comoment"))
    names = F.array(*map(F.lit, columns))
    mean = (F.col("n") + 1) / 2
    return sums.select(
        *keys, F.get(names, "i").alias("var1"), F.get(names, "j").alias("var2"), "n", mean.alias("mean1"), mean.alias("mean2"), "comoment"
    )
