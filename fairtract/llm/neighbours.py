"""Approximate nearest neighbours: stable projections in kd-trees, verified until a chi-square test holds."""

from __future__ import annotations

from math import exp, factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtract.llm.storage import stage

#: Dimensions of the projections; even, so that the chi-square distribution is a finite sum.
PROJECTED = 8
#: A vector is passed over when a better neighbour would lie as far off in the projection with less than the rest
#: of this probability.
CERTAINTY = 0.97
#: Rows of a leaf, which are looked at together.
LEAF = 64
#: Distinct vectors of one tree, and queries that are sent to it at once.
TREE_ROWS = 16_384
QUERY_ROWS = 512
#: Vectors, at most about, whose projections place the cuts between cells. All vectors are indexed.
SAMPLE_ROWS = 65_536
#: Trees whose boxes (128 bytes each) a task may hold; with more, queries go to all trees.
MOST_BOXES = 100_000
SEED = 11


def chi_square(x: float, degrees: int = PROJECTED) -> float:
    """Distribution function for an even number of degrees of freedom."""
    half = x / 2
    return 1.0 - exp(-half) * sum(half**i / factorial(i) for i in range(degrees // 2)) if half < 700 else 1.0


def test_bound(certainty: float) -> float:
    """The x at which the distribution function reaches the certainty."""
    low, high = 0.0, 1.0
    while chi_square(high) < certainty:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) < certainty else (low, middle)
    return high


def projection(dimensions: int) -> np.ndarray:
    """The same normal, hence 2-stable, directions in every task."""
    return np.random.default_rng(SEED + dimensions).standard_normal((dimensions, PROJECTED))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Directions; scaled by the largest component first, so that squares neither vanish nor overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


class Tree:
    """A kd-tree over projected directions: points by leaf, and the box of each leaf."""

    def __init__(self, vectors: np.ndarray):
        points = unit(vectors) @ projection(vectors.shape[1])
        order, todo, leaves = np.arange(len(points)), [(0, len(points))], []
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                leaves.append((a, b))
                continue
            own = points[order[a:b]]
            widest = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, widest], middle)]
            todo += [(a, a + middle), (a + middle, b)]
        self.leaves = np.array(sorted(leaves))
        self.order = order
        self.low = np.array([points[order[a:b]].min(axis=0) for a, b in self.leaves])
        self.high = np.array([points[order[a:b]].max(axis=0) for a, b in self.leaves])
        self.points = points[order]


def search(vectors: np.ndarray, tree: tuple, queries: np.ndarray, worst: np.ndarray, k: int, certainty: float):
    """Per query the rows of the best directions that were met, ``k`` at most, their cosines, and how many were verified.

    ``tree`` is the order of the vectors by leaf, the leaves, their boxes and the projections in that order.
    ``worst`` is the squared distance of the k-th neighbour that a query has already. Leaves come in
    the order of their distance in the projection, and of a leaf those vectors are verified that pass the
    test: a neighbour nearer than the best ``k`` so far has a squared projected distance beyond a
    chi-square variable's multiple of theirs with little probability. The search ends at a leaf that does not pass.
    """
    bound = test_bound(certainty)
    order, leaves, low, high, points = tree
    directions = unit(vectors)[order]
    for query, most in zip(unit(queries), worst):
        at = query @ projection(len(query))
        gap = np.maximum(0.0, np.maximum(low - at, at - high))
        far = (gap * gap).sum(axis=1)
        rows, cosines, verified = np.zeros(0, np.int64), np.zeros(0), 0
        for leaf in np.argsort(far, kind="stable"):
            if far[leaf] > bound * most:
                break
            a, b = leaves[leaf]
            near = np.arange(a, b)
            if most < np.inf:
                near = near[((points[a:b] - at) ** 2).sum(axis=1) <= bound * most]
            verified += len(near)
            rows, cosines = np.append(rows, near), np.append(cosines, directions[near] @ query)
            if len(rows) > k:
                best = np.argpartition(-cosines, k - 1)[:k]
                rows, cosines = rows[best], cosines[best]
            if len(rows) == k:
                most = min(most, max(0.0, 2 - 2 * cosines.min()))
        rows = order[rows]
        yield rows, (unit(vectors[rows]) * query).sum(axis=1), verified


class Cells:
    """Cuts of the projected space, one after the other: ``(dimension, cut, cell below, cell above)``; cells are negative."""

    def __init__(self, points: np.ndarray, n: int):
        self.cuts: list[list] = []
        self.n = 0
        self.top = self._cut(points, n)

    def _cut(self, points: np.ndarray, n: int) -> int:
        if n < 2 or len(points) < 2 * LEAF:
            self.n += 1
            return -self.n
        widest = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
        cut = float(np.median(points[:, widest]))
        below = points[:, widest] <= cut
        if below.all():
            self.n += 1
            return -self.n
        mine = len(self.cuts)
        self.cuts.append([widest, cut, 0, 0])
        self.cuts[mine][2] = self._cut(points[below], n // 2)
        self.cuts[mine][3] = self._cut(points[~below], n - n // 2)
        return mine

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.top)
        while (open_ := np.flatnonzero(at >= 0)).size:
            for cut in np.unique(at[open_]):
                rows = open_[at[open_] == cut]
                widest, value, below, above = self.cuts[cut]
                at[rows] = np.where(points[rows, widest] <= value, below, above)
        return -1 - at


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), dtype=float).reshape(len(lists), -1)


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row per tree: its vectors and ids in one order, its leaves, and the box around it."""
    table = table.sort_by("cls").combine_chunks()
    vectors = _matrix(table["embedding"])
    tree = Tree(vectors)
    parts = _pack(table["cls"].to_numpy(), vectors, tree.order, tree.leaves, tree.low, tree.high, tree.points)
    box = np.concatenate([tree.low.min(axis=0), tree.high.max(axis=0)])
    names = ("dimensions", "cell", "part")
    return pa.table(
        {
            **{n: pa.array([k.as_py()], pa.int32()) for n, k in zip(names, key)},
            "box": pa.array([box.tolist()], pa.list_(pa.float64())),
            "tree": pa.array([parts], pa.list_(pa.binary())),
        }
    )


def _gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Queries of a cell in one row: ids, vectors and the distance within which neighbours are wanted."""
    parts = _pack(table["cls"].to_numpy(), _matrix(table["embedding"]), table["worst"].to_numpy())
    names = ("dimensions", "cell", "group")
    return pa.table(
        {**{n: pa.array([k.as_py()], pa.int32()) for n, k in zip(names, key)}, "queries": pa.array([parts], pa.list_(pa.binary()))}
    )


_GATHERED = "dimensions int, cell int, group int, queries array<binary>"


def _opened(queries, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    asked, wanted, worst = (b.as_buffer() for b in queries)
    return np.frombuffer(asked, np.int64), np.frombuffer(wanted).reshape(-1, d), np.frombuffer(worst)


def _sent(boxes: dict[int, list[tuple[int, int, list[float]]]], certainty: float):
    """Queries to the trees, outside of their own cell, whose boxes their test leaves open."""

    def sent(batches):
        bound = test_bound(certainty)
        for batch in batches:
            for d, cell, queries in zip(batch.column("dimensions").to_pylist(), batch.column("cell").to_pylist(), batch.column("queries")):
                asked, wanted, worst = _opened(queries, d)
                at = unit(wanted) @ projection(d)
                for other, part, box in boxes.get(d, ()):
                    if other == cell:
                        continue
                    low, high = np.array(box[:PROJECTED]), np.array(box[PROJECTED:])
                    gap = np.maximum(0.0, np.maximum(low - at, at - high))
                    open_ = np.flatnonzero((gap * gap).sum(axis=1) <= bound * worst)
                    if len(open_):
                        parts = _pack(asked[open_], wanted[open_], worst[open_])
                        yield pa.RecordBatch.from_pydict(
                            {"dimensions": pa.array([d], pa.int32()), "cell": pa.array([other], pa.int32()), "part": pa.array([part], pa.int32()), "queries": pa.array([parts], pa.list_(pa.binary()))}
                        )

    return sent


def _searched(k: int, certainty: float):
    def searched(batches):
        for batch in batches:
            for d, tree, queries in zip(batch.column("dimensions").to_pylist(), batch.column("tree"), batch.column("queries")):
                ids, vectors, order, leaves, low, high, points = (b.as_buffer() for b in tree)
                ids, vectors = np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, d)
                leaves = np.frombuffer(leaves, np.int64).reshape(-1, 2)
                projected = [np.frombuffer(x).reshape(-1, PROJECTED) for x in (low, high, points)]
                asked, wanted, worst = _opened(queries, d)
                of, found, cosine, verified = [], [], [], []
                tried = search(vectors, (np.frombuffer(order, np.int64), leaves, *projected), wanted, worst, k, certainty)
                for query, (rows, cosines, n) in zip(asked, tried):
                    # A row without a neighbour carries the number of verified vectors.
                    of.append(np.full(len(rows) + 1, query))
                    found.append(np.append(ids[rows], query))
                    cosine.append(np.append(cosines, np.nan))
                    verified.append(np.append(np.zeros(len(rows), np.int64), n))
                if of:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in (of, found, cosine, verified)], ["query_cls", "cls", "score", "verified"]
                    )

    return searched


_MET = "query_cls long, cls long, score double, verified long"


def _projected(batches):
    for batch in batches:
        for d in set(batch.column("dimensions").to_pylist()):
            own = batch.filter(pa.compute.equal(batch.column("dimensions"), d))
            points = unit(_matrix(own.column("embedding"))) @ projection(d)
            yield pa.RecordBatch.from_arrays([own.column("dimensions"), pa.array(points.tolist(), pa.list_(pa.float64()))], ["dimensions", "point"])


def _cells(classes: DataFrame, n_trees: int) -> dict[int, Cells]:
    """Cuts between cells by number of dimensions, from the projections of a bounded sample."""
    share = SAMPLE_ROWS / max(classes.count(), 1)
    near = F.pmod(F.xxhash64("cls", F.lit(SEED)), F.lit(1 << 30)) < int(min(share, 1.0) * (1 << 30))
    sample = classes.where(near).limit(2 * SAMPLE_ROWS).select("dimensions", "embedding")
    points: dict[int, list] = {}
    for row in sample.mapInArrow(_projected, "dimensions int, point array<double>").collect():
        points.setdefault(row.dimensions, []).append(row.point)
    return {d: Cells(np.array(p), n_trees) for d, p in points.items()}


def _with_cells(classes: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    def placed(batches):
        for batch in batches:
            cell = np.zeros(len(batch), np.int32)
            dimensions = batch.column("dimensions").to_numpy()
            for d in np.unique(dimensions):
                at = np.flatnonzero(dimensions == d)
                if d in cells:
                    cell[at] = cells[d].of(unit(_matrix(batch.column("embedding").take(pa.array(at)))) @ projection(d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    rows = classes.select("cls", "embedding", "dimensions")
    return rows.mapInArrow(placed, "cls long, embedding array<double>, dimensions int, cell int")


def _groups(queries: DataFrame) -> DataFrame:
    """Queries (``cls, embedding, dimensions, cell, worst``) of a cell in rows of about ``QUERY_ROWS``."""
    sizes = queries.groupBy("dimensions", "cell").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).alias("groups"))
    dealt = queries.join(stage(sizes, "sizes"), ["dimensions", "cell"])
    group = F.pmod(F.xxhash64("cls"), F.col("groups")).cast("int")
    return dealt.withColumn("group", group).groupBy("dimensions", "cell", "group").applyInArrow(_gather, _GATHERED)


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, certainty: float = CERTAINTY) -> DataFrame:
    """The ``k`` nearest by cosine for each query among ``vectors(vec_id, embedding)``.

    Equal vectors are one class and are searched once, so very many copies of
    one vector neither crowd a tree nor repeat a search; a class brings along
    its ``k + 1`` smallest ids, more than any answer needs. The projected space is cut into cells
    of about ``TREE_ROWS`` classes, by the projections of a bounded sample, and a cell that holds more has several
    trees; every class is in one. A query searches the trees of its own cell first. With the
    distance of what it has found there it goes on to those trees only whose box its test leaves open.

    Returns ``query_id, rank, vec_id, score`` with ranks from 1, ties to the
    smaller vec_id; the score is the cosine of the original vectors in double
    precision. Rows without an id, and vectors that are null, empty, zero or
    hold null or non-finite components, take no part; vectors of other lengths
    are no candidates. Repeated rows with the same id and vector count once,
    and no row of the query's own id is a candidate. A query with fewer
    candidates gets them all, one without gets no row. Other columns are not
    read.
    """
    usable, classes = _classes(vectors, is_query, k)
    asked = stage(
        usable.where("asked").select("vec_id", "embedding").join(classes, "embedding").select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query_cls")),
        "queries",
    )
    met = verify(classes, asked.select(F.col("query_cls").alias("cls")).distinct(), k, certainty).where("not isnan(score)")
    best = Window.partitionBy("query_cls").orderBy(F.desc("score"), "cls")
    near = met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    # The best k + 1 ids of a class of queries hold the best k of each of them.
    listed = near.join(classes.select("cls", "ids"), "cls").select("query_cls", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query_cls").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1).drop("place")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.join(listed, "query_cls")
        .where(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _classes(vectors: DataFrame, is_query: Column, k: int) -> tuple[DataFrame, DataFrame]:
    usable = stage(
        vectors.where(_usable(F.col("embedding")) & F.col("vec_id").isNotNull())
        .select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asked"))
        .dropDuplicates(["vec_id", "embedding"]),
        "vectors",
    )
    first = Window.partitionBy("embedding").orderBy("vec_id")
    classes = stage(
        usable.withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= k + 1)
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("cls"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumn("dimensions", F.size("embedding")),
        "classes",
    )
    return usable, classes


def verify(classes: DataFrame, wanted: DataFrame, k: int, certainty: float = CERTAINTY) -> DataFrame:
    """``query_cls, cls, score, verified`` of the best ``k + 1`` classes that each tree gave for each of ``wanted(cls)``.

    A row with the score NaN per query and tree says how many vectors were verified there.
    """
    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_trees = max(1, -(-classes.count() // TREE_ROWS))
    placed = stage(_with_cells(classes, _cells(classes, n_trees)), "cells")
    sizes = placed.groupBy("dimensions", "cell").agg(F.ceil(F.count("*") / F.lit(2 * TREE_ROWS)).alias("parts"))
    dealt = placed.join(stage(sizes, "sizes"), ["dimensions", "cell"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")).select("cls", "embedding", "dimensions", "cell", "part")
    trees = stage(
        dealt.groupBy("dimensions", "cell", "part").applyInArrow(_build, "dimensions int, cell int, part int, box array<double>, tree array<binary>"), "trees"
    )
    queries = placed.join(wanted, "cls", "left_semi")

    def found(sent: DataFrame, on: list[str]) -> DataFrame:
        # Each block of queries meets each of its trees by an equal key.
        met = trees.join(sent, on).repartition(partitions).select("dimensions", "tree", "queries")
        return met.mapInArrow(_searched(k + 1, certainty), _MET)

    home = stage(found(_groups(queries.withColumn("worst", F.lit(float("inf")))), ["dimensions", "cell"]), "home")
    best = Window.partitionBy("query_cls").orderBy(F.desc("score"), "cls")
    kth = home.where("not isnan(score)").withColumn("place", F.row_number().over(best)).where(F.col("place") == k + 1)
    kth = kth.select(F.col("query_cls").alias("cls"), F.greatest(F.lit(0.0), 2 - 2 * F.col("score")).alias("worst"))
    bounded = queries.join(kth, "cls", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
    listed = trees.select("dimensions", "cell", "part", "box")
    boxes: dict[int, list] = {}
    if trees.count() <= MOST_BOXES:
        for row in listed.collect():
            boxes.setdefault(row.dimensions, []).append((row.cell, row.part, row.box))
        sent = _groups(bounded).mapInArrow(_sent(boxes, certainty), "dimensions int, cell int, part int, queries array<binary>")
        return home.unionByName(found(sent, ["dimensions", "cell", "part"]))
    others = listed.select("dimensions", F.col("cell").alias("other"), "part")
    sent = _groups(bounded).join(others, "dimensions").where("other <> cell").select("dimensions", F.col("other").alias("cell"), "part", "queries")
    return home.unionByName(found(sent, ["dimensions", "cell", "part"]))
