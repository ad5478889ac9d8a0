"""Boosted-tree outcome models and their exact per-tract feature contributions.

Contributions follow interventional Tree SHAP (Lundberg et al. 2020). A leaf
splits its path into at most ``depth`` features with one interval each. Which
intervals a row satisfies is a bit pattern, so the background enters only as
counts per leaf and pattern, and the contribution of a leaf depends only on
the pattern of the row. Both passes over the data are partition-local; what
is shuffled or shipped is bounded by the size of the model.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairtract.operators.select import complete_cases
from fairtract.schema import MODEL_FEATURES, OUTCOME_COLUMNS
from fairtract.staging import new_path

# Rows evaluated together inside a task; bounds the rows-by-leaves work arrays.
CHUNK = 1024
# Intervals of a leaf: patterns and the driver's tables grow with two to this power.
MAX_SLOTS = 8


@dataclass
class OutcomeModel:
    outcome: str
    features: list[str]
    model: GBTRegressionModel | None = None


def model_data(
    df: DataFrame, features: Sequence[str] = MODEL_FEATURES
) -> tuple[DataFrame, list[str], list[str]]:
    """Rows complete in all available features and outcomes; also names the missing features."""
    available = [c for c in features if c in df.columns]
    outcomes = [c for c in OUTCOME_COLUMNS.values() if c in df.columns]
    missing = [c for c in features if c not in df.columns]
    return complete_cases(df, [*available, *outcomes]), available, missing


def fit_outcome(
    df: DataFrame, features: Sequence[str], outcome: str, trees: int = 100, depth: int = 4,
    min_leaf: int = 20, seed: int = 42,
) -> OutcomeModel:
    """Boosted regression trees for one outcome; rows must be complete."""
    features = list(features)
    assembled = _assemble(df, features).select("features", F.col(OUTCOME_COLUMNS[outcome]).alias("label"))
    regressor = GBTRegressor(
        maxIter=trees, maxDepth=depth, minInstancesPerNode=min_leaf, stepSize=0.1, seed=seed, maxBins=64
    )
    cached = assembled.persist()
    try:
        return OutcomeModel(outcome, features, regressor.fit(cached))
    finally:
        cached.unpersist()


def _assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def predict(df: DataFrame, fitted: OutcomeModel) -> DataFrame:
    column = f"pred_{fitted.outcome}"
    scored = fitted.model.transform(_assemble(df, fitted.features))
    return scored.withColumnRenamed("prediction", column).drop("features")


def residual_table(df: DataFrame, models: Sequence[OutcomeModel], keys: Sequence[str] = ("ID",)) -> DataFrame:
    """``keys, outcome, actual, predicted, residual``."""
    for fitted in models:
        df = predict(df, fitted)
    return residuals(df, [m.outcome for m in models], keys)


def residuals(df: DataFrame, outcomes: Sequence[str], keys: Sequence[str] = ("ID",)) -> DataFrame:
    """As ``residual_table``, of predictions that ``df`` holds as ``pred_<outcome>``."""
    entries = [
        F.struct(
            F.lit(outcome).alias("outcome"),
            F.col(OUTCOME_COLUMNS[outcome]).alias("actual"),
            F.col(f"pred_{outcome}").alias("predicted"),
        )
        for outcome in outcomes
    ]
    long = df.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")
    return long.withColumn("residual", F.col("actual") - F.col("predicted"))


@dataclass
class LeafTable:
    """Leaves of all trees: weighted value, per slot a feature with its interval (low, high], and the number of the tree."""

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    tree: np.ndarray | None = None

    @property
    def slots(self) -> int:
        return self.feature.shape[1]

    def patterns(self, x: np.ndarray) -> np.ndarray:
        """Bit pattern of satisfied intervals, rows by leaves. Unused slots are always satisfied."""
        out = np.zeros((len(x), len(self.value)), dtype=np.int64)
        for s in range(self.slots):
            v = x[:, self.feature[:, s]]
            out |= ((v > self.low[:, s]) & (v <= self.high[:, s])).astype(np.int64) << s
        return out


def leaf_table(spark, fitted: OutcomeModel) -> LeafTable:
    """Leaves of a fitted model, read from its saved node table.

    The table has at most trees x 2^(depth+1) rows, whatever the data.
    """
    path = new_path(spark, "model")
    fitted.model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID",
        "nodeData.id",
        "nodeData.prediction",
        "nodeData.leftChild",
        "nodeData.rightChild",
        "nodeData.split.featureIndex",
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    trees: dict[int, dict[int, object]] = {}
    for node in nodes.collect():
        trees.setdefault(node.treeID, {})[node.id] = node
    weights = fitted.model.treeWeights
    leaves = []
    for tree, by_id in trees.items():
        open_nodes = [(0, {})]
        while open_nodes:
            number, box = open_nodes.pop()
            node = by_id[number]
            if node.leftChild < 0:
                leaves.append((weights[tree] * node.prediction, box, tree))
                continue
            low, high = box.get(node.featureIndex, (-np.inf, np.inf))
            cut = node.threshold
            open_nodes.append((node.leftChild, {**box, node.featureIndex: (low, min(high, cut))}))
            open_nodes.append((node.rightChild, {**box, node.featureIndex: (max(low, cut), high)}))
    slots = max(1, max(len(box) for _, box, _ in leaves))
    shape = (len(leaves), slots)
    feature = np.zeros(shape, dtype=np.int64)
    low, high = np.full(shape, -np.inf), np.full(shape, np.inf)
    for i, (_, box, _) in enumerate(leaves):
        for s, (f, (a, b)) in enumerate(box.items()):
            feature[i, s], low[i, s], high[i, s] = f, a, b
    return LeafTable(np.array([v for v, _, _ in leaves]), feature, low, high, np.array([t for _, _, t in leaves]))


def leaf_rows(spark, fitted: OutcomeModel) -> DataFrame:
    """The fitted ensemble as a table that plain SQL can score: ``leaf, value, feature, low, high, tree``.

    A leaf has one row per feature on its path; a tract is in the leaf if each of these features
    is above ``low`` and up to ``high``. The prediction is the sum of its leaves' values. The table is
    bounded by the model; a leaf without conditions has one row without a feature.
    """
    table = leaf_table(spark, fitted)
    rows = []
    for leaf, (value, tree) in enumerate(zip(table.value.tolist(), table.tree.tolist())):
        boxes = {
            (fitted.features[f], a, b)
            for f, a, b in zip(table.feature[leaf].tolist(), table.low[leaf].tolist(), table.high[leaf].tolist())
            if a > -np.inf or b < np.inf
        }
        rows += [(leaf, value, *box, tree) for box in sorted(boxes)] or [(leaf, value, None, None, None, tree)]
    return spark.createDataFrame(rows, "leaf int, value double, feature string, low double, high double, tree int")


#: Beyond any number: a feature that is missing or not finite is in no interval.
MOST = float(np.finfo(float).max)
_NODE = "f:int,cut:double,left:int,right:int,value:double"


def _nodes(leaves: list[tuple[float, dict[int, tuple[float, float]]]]) -> list[dict]:
    """Leaves (value, intervals by feature) as nodes to walk from the first one: up to ``cut`` to the left, else to the right.

    A cut that divides the leaves without splitting one is taken, as a tree's root does. Leaves of no tree are
    split where they must.
    """
    nodes: list[dict] = []

    def grow(own: list, region: dict) -> int:
        at = len(nodes)
        nodes.append({"value": 0.0})
        best = None
        for f, cut in sorted({(f, c) for _, box in own for f, ends in box.items() for c in ends}):
            low, high = region.get(f, (-np.inf, np.inf))
            if low < cut < high:
                left = [leaf for leaf in own if leaf[1].get(f, (-np.inf, np.inf))[0] < cut]
                right = [leaf for leaf in own if leaf[1].get(f, (-np.inf, np.inf))[1] > cut]
                if best is None or len(left) + len(right) < best[0]:
                    best = (len(left) + len(right), f, cut, left, right)
        if best is None:
            nodes[at]["value"] = math.fsum(value for value, _ in own)
        else:
            _, f, cut, left, right = best
            low, high = region.get(f, (-np.inf, np.inf))
            nodes[at] |= {"f": f, "cut": cut, "left": grow(left, {**region, f: (low, cut)}), "right": grow(right, {**region, f: (cut, high)})}
        return at

    grow(leaves, {})
    return nodes


def _steps(nodes: list[dict], at: int = 0) -> int:
    node = nodes[at]
    return 1 + max(_steps(nodes, node["left"]), _steps(nodes, node["right"])) if "f" in node else 0


def leaf_score(leaves: DataFrame, features: Sequence[str]) -> Column:
    """The prediction of a stored leaf table as a column over ``features``, without the model.

    The leaves of a tree are put together to the tree again, so that a row takes one path through each.
    """
    place = {name: i for i, name in enumerate(features)}
    found: dict[int, dict[int, tuple[float, dict]]] = {}
    for row in leaves.select("tree", "leaf", "value", "feature", "low", "high").orderBy("tree", "leaf").collect():
        _, box = found.setdefault(row.tree, {}).setdefault(row.leaf, (row.value, {}))
        if row.feature is not None:
            box[place[row.feature]] = (row.low, row.high)
    trees = [_nodes(list(own.values())) for own in found.values()]
    steps = F.array(*map(F.lit, range(max(map(_steps, trees), default=0))))
    known = F.from_json(F.lit(json.dumps(trees)), f"array<array<struct<{_NODE}>>>")
    nothing = F.lit(None).cast(f"struct<{_NODE}>")

    def score(x: Column) -> Column:
        def step(tree: Column, node: Column) -> Column:
            value = F.get(x, node["f"])
            inside = value.between(-MOST, MOST)
            onward = F.when(inside, F.get(tree, F.when(value <= node["cut"], node["left"]).otherwise(node["right"]))).otherwise(nothing)
            return F.when(node["f"].isNull(), node).otherwise(onward)

        def add(total: Column, tree: Column) -> Column:
            last = F.aggregate(steps, F.get(tree, F.lit(0)), lambda node, _: step(tree, node))
            return total + F.coalesce(last["value"], F.lit(0.0))

        return F.aggregate(known, F.lit(0.0), add)

    # The features are bound once a row.
    return F.transform(F.array(F.array(*[F.col(f).cast("double") for f in features])), score)[0]


def pattern_counts(df: DataFrame, features: Sequence[str], models: Sequence[LeafTable]) -> DataFrame:
    """Background rows per model, leaf and pattern; each task emits its own totals only."""
    features = list(features)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [np.zeros(len(m.value) << m.slots, dtype=np.int64) for m in models]
        for x in _chunks(batches, features):
            for m, total in zip(models, totals):
                cells = m.patterns(x) + (np.arange(len(m.value)) << m.slots)
                total += np.bincount(cells.ravel(), minlength=len(total))
        for i, total in enumerate(totals):
            hit = np.flatnonzero(total)
            yield pd.DataFrame({"model": i, "cell": hit, "n": total[hit]})

    partial = df.select(*features).mapInPandas(tally, "model int, cell long, n long")
    return partial.groupBy("model", "cell").agg(F.sum("n").alias("n"))


def _chunks(batches: Iterator[pd.DataFrame], features: list[str]) -> Iterator[np.ndarray]:
    for batch in batches:
        x = batch[features].to_numpy(dtype=float)
        for start in range(0, len(x), CHUNK):
            yield x[start : start + CHUNK]


def contribution_table(leaves: LeafTable, counts: np.ndarray) -> np.ndarray:
    """Contribution of each leaf to each of its slots for every row pattern, mean over the background.

    For a row pattern and a background pattern, ``a`` intervals hold only for
    the row and ``b`` only for the background; where some interval holds for
    neither, the leaf is out of reach and adds nothing.
    """
    slots, size = leaves.slots, 1 << leaves.slots
    share = counts / counts.sum(axis=1, keepdims=True)
    out = np.zeros((len(leaves.value), size, slots))
    for p in range(size):
        for q in range(size):
            if p | q != size - 1:
                continue
            only_row, only_back = p & ~q, q & ~p
            a, b = only_row.bit_count(), only_back.bit_count()
            gain = loss = 0.0
            if a:
                gain = math.factorial(a - 1) * math.factorial(b) / math.factorial(a + b)
            if b:
                loss = math.factorial(a) * math.factorial(b - 1) / math.factorial(a + b)
            for s in range(slots):
                sign = gain * (only_row >> s & 1) - loss * (only_back >> s & 1)
                out[:, p, s] += sign * leaves.value * share[:, q]
    return out


@dataclass
class Explainer:
    """Leaves of one model with the contribution of every leaf, pattern and slot."""

    leaves: LeafTable
    table: np.ndarray
    to_feature: np.ndarray

    def contributions(self, x: np.ndarray) -> np.ndarray:
        phi = self.table[np.arange(len(self.leaves.value)), self.leaves.patterns(x)]
        return phi.reshape(len(x), -1) @ self.to_feature


def _explainer(leaves: LeafTable, counts: np.ndarray, width: int) -> Explainer:
    to_feature = np.zeros((*leaves.feature.shape, width))
    used = np.isfinite(leaves.low) | np.isfinite(leaves.high)
    for leaf, slot in zip(*np.nonzero(used)):
        to_feature[leaf, slot, leaves.feature[leaf, slot]] = 1.0
    return Explainer(leaves, contribution_table(leaves, counts), to_feature.reshape(-1, width))


def tree_shap(
    df: DataFrame,
    models: Sequence[OutcomeModel],
    background: DataFrame | None = None,
    leaves: Sequence[LeafTable] | None = None,
) -> DataFrame:
    """Add ``shap_<outcome>_<feature>`` columns; each row's sum is its prediction minus the background mean.

    All models must share their features, and are explained in one pass. The
    background is the whole input unless another table is given. ``leaves``
    replaces the models' own trees, in the same order. Leaves over more than
    ``MAX_SLOTS`` features are refused, as the work grows with two to that power.
    """
    features = models[0].features
    leaves = list(leaves) if leaves is not None else [leaf_table(df.sparkSession, m) for m in models]
    if max(m.slots for m in leaves) > MAX_SLOTS:
        raise ValueError(f"leaves over more than {MAX_SLOTS} features; fit trees of less depth")
    counts = [np.zeros(len(m.value) << m.slots) for m in leaves]
    # At most leaves x 2^depth rows come back per model, a bound set by the model.
    for row in pattern_counts(background if background is not None else df, features, leaves).collect():
        counts[row.model][row.cell] = row.n
    explainers = [
        _explainer(m, total.reshape(len(m.value), -1), len(features)) for m, total in zip(leaves, counts)
    ]
    added = [f"shap_{m.outcome}_{f}" for m in models for f in features]

    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in added])

    # Only the features travel to Python; all other columns stay on the JVM side.
    @F.pandas_udf(schema)
    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [np.hstack([e.contributions(x) for e in explainers]) for x in _chunks(iter([batch]), features)]
            shap = np.concatenate(parts) if parts else np.zeros((0, len(added)))
            yield pd.DataFrame(shap, columns=added)

    return df.withColumn("_shap", explain(F.struct(*features))).select(*df.columns, "_shap.*")
