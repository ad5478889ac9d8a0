"""Near duplicates by minhash bands, sequential Bayesian verification and exact confirmation."""

from __future__ import annotations

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairtract.llm.graph import components
from fairtract.llm.storage import drop, stage
from fairtract.llm.words import U64, Words, byte_slices, mix, runs, window_hashes

#: 30 bands of 5: a pair of similarity 0.8 shares no band with probability 7e-6.
BANDS, ROWS = 30, 5
#: Signature positions that are compared before each decision.
BATCH = 30
#: A pair goes when its similarity reaches the threshold with less probability than this.
MISS = 1e-6
#: Members of a bucket that are compared with as many others at once.
CELL = 256

_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(1, 2**63, BANDS * ROWS).astype(U64) * U64(2) + U64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, BANDS * ROWS).astype(U64)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its k-word shingles; of a shorter text its whole sequence."""
    h = window_hashes(words.hashes, k)
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            sets.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            sets.append(window_hashes(words.hashes[a:b], b - a) ^ U64(b - a))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def signature(items: np.ndarray) -> np.ndarray:
    """Low 16 bits of the smallest value under each of the hash functions."""
    least = np.full(len(_FACTORS), 2**64 - 1, U64)
    for a in range(0, len(items), 1024):
        values = items[a : a + 1024, None] * _FACTORS
        values += _SHIFTS
        np.minimum(least, values.min(axis=0), out=least)
    return (least >> U64(24)).astype("<u2")


def _signatures(k: int):
    def signatures(batches):
        for batch in (b.slice(start, stop - start) for b in batches for start, stop in byte_slices(b.column("text"))):
            sets = shingle_sets(Words(batch.column("text"), lower=True), k)
            low = np.array([np.add.reduce(mix(s)) for s in sets], U64).view(np.int64)
            high = np.array([np.add.reduce(mix(s ^ U64(0x5851F42D4C957F2D))) for s in sets], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(low),
                    pa.array(high),
                    pa.array([signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "low", "high", "signature"],
            )

    return signatures


@cache
def least_matches(n: int, percent: int, miss: float) -> int:
    """Fewest matches of ``n`` at which the threshold is still likely enough.

    With a uniform prior the posterior of the similarity is a beta
    distribution, whose upper tail at the threshold is a binomial sum.
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def survivors(left: np.ndarray, right: np.ndarray, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature matrices that pass all batches, and their matches."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for a in range(0, left.shape[1], BATCH):
        b = min(a + BATCH, left.shape[1])
        matches[alive] += (left[alive, a:b] == right[alive, a:b]).sum(axis=1)
        alive = alive[matches[alive] >= least_matches(b, percent, miss)]
    return alive, matches[alive]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), BANDS * ROWS)


def _compare(percent: int, miss: float):
    def compare(batches):
        for batch in batches:
            alive, matches = survivors(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), percent, miss)
            kept = batch.select(["a", "b"]).take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(matches, pa.int64())], ["a", "b", "matches"])

    return compare


CELLS = "group long, cell long, doc long, pairs binary"


def _cell_rows(rows: list[tuple]) -> pa.Table:
    group, cell, doc, pairs = zip(*rows) if rows else ((), (), (), ())
    return pa.table(
        {
            "group": pa.array(group, pa.int64()),
            "cell": pa.array(cell, pa.int64()),
            "doc": pa.array(doc, pa.int64()),
            "pairs": pa.array(pairs, pa.binary()),
        }
    )


def _compare_cells(percent: int, miss: float):
    """Pairs of a cell in different components that may be linked: one row that packs them, one per class in them.

    A pair is taken in the first band that its classes share, so in one cell only.
    """

    def compare_cells(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("cls", "ascending")]).combine_chunks()
        cell, cls, place = (table[c].to_numpy() for c in ("cell", "cls", "place"))
        component, second = table["component"].to_numpy(), table["second"].to_numpy()
        matrix = _matrix(table["signature"].combine_chunks())
        bounds = np.append(runs(cell), len(cell))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            # In a cell of two blocks only pairs between them are new.
            rows = np.flatnonzero(~second[a:b]) + a
            others = np.flatnonzero(second[a:b]) + a
            one = not len(others)
            others = rows if one else others
            found = []
            for start in range(0, len(rows), CELL):
                i, j = np.meshgrid(rows[start : start + CELL], others, indexing="ij")
                i, j = i.ravel(), j.ravel()
                new = (component[i] != component[j]) & ((i < j) if one else True)
                i, j = i[new], j[new]
                alive, _ = survivors(matrix[i], matrix[j], percent, miss)
                i, j = i[alive], j[alive]
                before = int(place[a]) * ROWS
                same = (matrix[i, :before] == matrix[j, :before]).reshape(len(i), int(place[a]), ROWS).all(axis=2).any(axis=1)
                found.append(np.stack([cls[i[~same]], cls[j[~same]]], axis=1))
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            if len(pairs):
                out.append((key[0].as_py(), int(cell[a]), None, pairs.tobytes()))
                out += [(key[0].as_py(), int(cell[a]), int(d), None) for d in np.unique(pairs)]
        return _cell_rows(out)

    return compare_cells


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _confirm_cells(percent: int):
    """Links of the packed pairs by whole sets, no more than join the classes of a cell."""

    def confirm_cells(key: tuple[pa.Scalar, ...], items: pa.Table, packed: pa.Table) -> pa.Table:
        sets: dict[int, dict[int, np.ndarray]] = {}
        for cell, doc, own in zip(items["cell"].to_pylist(), items["doc"].to_pylist(), items["items"]):
            sets.setdefault(cell, {})[doc] = np.frombuffer(own.as_buffer(), U64)
        links = []
        for cell, pairs in zip(packed["pairs_cell"].to_pylist(), packed["pairs"]):
            top: dict[int, int] = {}

            def root(d: int, top=top) -> int:
                while (up := top.get(d, d)) != d:
                    d = up
                return d

            for x, y in np.frombuffer(pairs.as_buffer(), np.int64).reshape(-1, 2).tolist():
                if root(x) != root(y) and _alike(sets[cell][x], sets[cell][y], percent):
                    top[root(x)] = root(y)
                    links.append((x, y))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return confirm_cells


def _sets(k: int):
    def sets(batches):
        for batch in batches:
            found = shingle_sets(Words(batch.column("text"), lower=True), k)
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in rest), pa.array([s.tobytes() for s in found], pa.binary())], [*rest, "items"]
            )

    return sets


def _confirm(percent: int):
    def confirm(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b")):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                linked.append(_alike(x, y, percent))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return confirm


def _exact(texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose whole shingle sets are similar enough."""
    # Pairs grow with the texts, so both are shuffled at every size; the texts once for both joins.
    left = texts.join(pairs.hint("merge"), texts.doc_id == pairs.a).select("a", "b", "text")
    left = left.mapInArrow(_sets(k), "a long, b long, items binary").withColumnRenamed("items", "items_a")
    right = texts.join(pairs.select("b").distinct().hint("merge"), texts.doc_id == F.col("b"), "left_semi")
    right = right.mapInArrow(_sets(k), "doc_id long, items binary").select(F.col("doc_id").alias("b"), F.col("items").alias("items_b"))
    return left.join(right, "b").select("a", "b", "items_a", "items_b").mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """Groups of ``docs(doc_id, text)`` whose shingle sets are linked by similarity.

    Words are lower-cased (A-Z) and a document's set holds its distinct
    ``shingle``-word sequences, or its whole sequence if it is shorter. Two
    documents are linked if ``100 * intersection >= percent * union``.

    1. Documents with equal sets are one class, found by a 128-bit digest; a
       class is known by its smallest doc_id. Copies go no further.
    2. Classes are banded by minhash signature. Every class of a bucket is
       compared with the bucket's hub, the class of most copies: by batches of
       signature positions, dropping pairs once the posterior says that the
       threshold is out of reach, then by whole sets for the best hub of each.
    3. Buckets whose classes are still in different components are compared
       once more, all pairs across components, in cells of bounded size: those
       outside of the bucket's largest component with all others. The pairs of
       a cell that may be linked stay packed together, and the sets of its
       classes are brought to them. So no link that joins two components is lost,
       however large a bucket is, and no pairs within a component are made.

    Returns one row per input row: ``doc_id, n_shingles, component_id, kept``.
    ``component_id`` is the smallest doc_id that can be reached, ``kept`` holds
    for that document alone. Null and empty texts have no shingles and are
    linked with nothing. Rows of equal doc_id are one document with several
    texts. Rows with a null doc_id are linked with nothing: their component is
    null and they are kept. Other columns are not read.
    """
    texts = docs.select("doc_id", "text")
    signed = stage(
        texts.mapInArrow(_signatures(shingle), "doc_id long, n_shingles long, low long, high long, signature binary"),
        "signatures",
    )
    digest = ["low", "high", "n_shingles"]
    classes = stage(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*digest)
        .agg(F.min("doc_id").alias("cls"), F.count("*").alias("copies"), F.first("signature").alias("signature")),
        "classes",
    )
    width = 2 * ROWS
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("signature"), i * width + 1, F.lit(width)))
    )
    banded = classes.select("cls", "copies", F.posexplode(bands).alias("place", "band"))
    hubs = (
        banded.groupBy("band")
        .agg(F.max_by("cls", F.struct("copies", -F.col("cls"))).alias("hub"), F.min("cls").alias("low"), F.max("cls").alias("high"))
        .where("low < high")
        .select("band", "hub")
    )
    members = stage(banded.join(hubs, "band").select("band", "place", "cls", "hub").distinct(), "buckets")
    signatures = classes.select("cls", "signature")
    first = signatures.toDF("a", "sig_a"), signatures.toDF("b", "sig_b")
    stars = members.where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct()
    compared = stars.join(first[0], "a").join(first[1], "b").select("a", "b", "sig_a", "sig_b")
    compared = compared.mapInArrow(_compare(percent, miss), "a long, b long, matches long")
    tried = stage(
        compared.groupBy("a").agg(F.max_by("b", F.struct("matches", -F.col("b"))).alias("b")),
        "tried",
    )
    links = stage(_exact(texts, tried, shingle, percent), "links")
    reached = components(links)

    labelled = members.join(reached.withColumnRenamed("node", "cls"), "cls", "left").select(
        "band", "place", "cls", F.coalesce("component", "cls").alias("component")
    )
    # Of each bucket the component with most members is its main one; pairs within it are not needed.
    mixed = (
        labelled.groupBy("band", "component")
        .count()
        .groupBy("band")
        .agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.max("count").alias("inside"), F.sum("count").alias("size"))
        .where("size > inside")
        .select(
            "band",
            "main",
            F.ceil(F.col("inside") / CELL).alias("main_blocks"),
            F.ceil((F.col("size") - F.col("inside")) / CELL).alias("other_blocks"),
        )
    )
    placed = labelled.join(mixed, "band").withColumn("in_main", F.col("component") == F.col("main")).withColumn(
        "block", F.pmod(F.xxhash64("cls"), F.when(F.col("in_main"), F.col("main_blocks")).otherwise(F.col("other_blocks")))
    )
    # Main blocks face the others; the others face those and each other.
    to_others = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)).alias("facing"))
    to_main = placed.where("not in_main").select("*", F.explode(F.sequence(F.lit(0), F.col("main_blocks") - 1)).alias("facing"))
    low, high = F.least("block", "facing"), F.greatest("block", "facing")
    cells = (
        to_others.select(
            "cls",
            "place",
            "component",
            F.when(F.col("in_main"), F.xxhash64("band", F.lit("main"), "block", "facing"))
            .otherwise(F.xxhash64("band", F.lit("other"), low, high))
            .alias("cell"),
            (F.col("in_main") | (F.col("block") > F.col("facing"))).alias("second"),
        )
        .unionByName(
            to_main.select("cls", "place", "component", F.xxhash64("band", F.lit("main"), "facing", "block").alias("cell"), F.lit(False).alias("second"))
        )
        .join(signatures, "cls")
    )
    groups = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    compared = (
        cells.withColumn("group", F.pmod("cell", F.lit(groups))).groupBy("group").applyInArrow(_compare_cells(percent, miss), CELLS)
    )
    across = stage(compared, "across")
    needed = across.where("doc is not null").select("group", "cell", "doc")
    own = texts.join(needed.select("doc").distinct().hint("merge"), texts.doc_id == F.col("doc"), "left_semi")
    own = own.mapInArrow(_sets(shingle), "doc_id long, items binary").withColumnRenamed("doc_id", "doc")
    items = needed.join(own, "doc").select("group", "cell", "doc", "items")
    packed = across.where("pairs is not null").select(F.col("group").alias("pairs_group"), F.col("cell").alias("pairs_cell"), "pairs")
    more = items.groupBy("group").cogroup(packed.groupBy("pairs_group")).applyInArrow(_confirm_cells(percent), "a long, b long")
    more = stage(more.distinct(), "links")
    rows = stage(signed.join(classes.select(*digest, "cls"), digest, "left").select("doc_id", "n_shingles", "cls"), "rows")
    # Texts of one doc_id belong together.
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b")
    same = rows.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("cls").alias("b")).where("a < b")
    final = components(links.unionByName(more).unionByName(same))
    for table in (signed, classes, members, tried, links, across, more):
        drop(table)
    return (
        rows.join(final.withColumnRenamed("node", "cls"), "cls", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "cls", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
