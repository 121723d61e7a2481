"""Exact attribution for forests and boosted trees: path-dependent Shapley values.

What a tree predicts without knowing some features is the mean over the
branches that their splits could take, weighted by the training rows (covers)
that took them. A leaf's part in a feature's Shapley value depends on a row only through
which of the features on its path the row agrees with, so each pattern of agreement
that occurs among a batch's rows is worked out once, and rows look it up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectloom.session import work_folder

#: Paths with at most so many features have their patterns in a table, others are sorted.
_TABLE_FEATURES = 12


@dataclass
class Leaf:
    """A leaf: its value (times its tree's weight), its share of the tree's rows, and for each feature on its path the conditions and the share of rows that meet them."""

    value: float
    share: float
    features: list[int] = field(default_factory=list)
    zero: list[float] = field(default_factory=list)
    #: For each feature: above this, at most that, and the categories that are allowed, if any are ruled out.
    bounds: list[tuple[float, float, np.ndarray | None]] = field(default_factory=list)


def tree_nodes(model, spark) -> list[dict[int, dict]]:
    """The nodes of each tree by id, read from the model as it is saved: prediction, statistics, children and split."""
    folder = work_folder(spark)
    model.write().overwrite().save(folder)
    data = spark.read.parquet(f"{folder}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.select(F.lit(0).alias("treeID"), "*")
    trees: dict[int, dict[int, dict]] = {}
    for r in data.collect():  # as large as the model, which every executor holds when it scores
        trees.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    return [trees[i] for i in sorted(trees)]


def _cover(node: dict, kind: str) -> float:
    stats = node["impurityStats"]
    return float(sum(stats)) if kind == "class" else float(stats[0])


def _value(node: dict, kind: str) -> float:
    stats = node["impurityStats"]
    return float(stats[1]) / float(sum(stats)) if kind == "class" else float(node["prediction"])


def leaves_of(nodes: dict[int, dict], kind: str, weight: float) -> list[Leaf]:
    """The leaves of one tree; splits of one feature on a path are one condition, their shares multiplied."""
    out: list[Leaf] = []
    whole = _cover(nodes[0], kind)
    work: list[tuple[int, dict[int, tuple[float, tuple[float, float, np.ndarray | None]]]]] = [(0, {})]
    while work:
        at, path = work.pop()
        node = nodes[at]
        if node["leftChild"] < 0:
            out.append(Leaf(weight * _value(node, kind), _cover(node, kind) / whole, list(path), [z for z, _ in path.values()], [b for _, b in path.values()]))
            continue
        split = node["split"]
        f, values, n = split["featureIndex"], split["leftCategoriesOrThreshold"], split["numCategories"]
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            zero, (low, high, allowed) = path.get(f, (1.0, (-np.inf, np.inf, None)))
            zero *= _cover(nodes[child], kind) / _cover(node, kind)
            if n < 0:
                low, high = (low, min(high, values[0])) if left else (max(low, values[0]), high)
            else:
                side = np.isin(np.arange(n), np.array(values, dtype=np.int64)) == left
                allowed = side if allowed is None else allowed & side
            work.append((child, path | {f: (zero, (low, high, allowed))}))
    return out


def pattern_values(patterns: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """For rows of agreement (0 or 1, by feature) the Shapley value of each feature in the product of these and the shares of the others.

    The number of subsets that agree in k features is a coefficient of the
    product of (share + agreement * x) over all features but one.
    """
    n, d = patterns.shape
    weights = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
    out = np.zeros((n, d))
    for i in range(d):
        poly = np.zeros((n, d))
        poly[:, 0] = 1.0
        for j in range(d):
            if j != i:
                shifted = np.zeros_like(poly)
                shifted[:, 1:] = poly[:, :-1] * patterns[:, j, None]
                poly = poly * zero[j] + shifted
        out[:, i] = (patterns[:, i] - zero[i]) * (poly @ weights)
    return out


def leaf_values(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """What a leaf adds to the values of its path's features, for every row of ``x``."""
    d = len(leaf.features)
    agree = np.empty((len(x), d), dtype=bool)
    for j, (f, (low, high, allowed)) in enumerate(zip(leaf.features, leaf.bounds)):
        v = x[:, f]
        agree[:, j] = (v > low) & (v <= high)
        if allowed is not None:
            c = v.astype(np.int64)
            agree[:, j] &= (c >= 0) & (c < len(allowed)) & allowed[np.clip(c, 0, len(allowed) - 1)]
    code = agree @ (1 << np.arange(d, dtype=np.int64))
    if d <= _TABLE_FEATURES:
        seen = np.zeros(1 << d, dtype=bool)
        seen[code] = True
        found = np.flatnonzero(seen)
        place = np.zeros(1 << d, dtype=np.int64)
        place[found] = np.arange(len(found))
        place = place[code]
    else:
        found, place = np.unique(code, return_inverse=True)
    patterns = (found[:, None] >> np.arange(d) & 1).astype(np.float64)
    return leaf.value * pattern_values(patterns, np.array(leaf.zero))[place]


def ensemble(model, spark) -> tuple[list[Leaf], float]:
    """(leaves of all trees, base value) of a forest, boosted trees or one tree; a forest's values are shares of the second class, boosted trees' are margins."""
    boosted = hasattr(model, "treeWeights") and type(model).__name__.startswith("GBT")
    kind = "value" if boosted else "class"
    trees = tree_nodes(model, spark)
    weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    leaves = [leaf for nodes, w in zip(trees, weights) for leaf in leaves_of(nodes, kind, w)]
    return leaves, sum(leaf.value * leaf.share for leaf in leaves)


def shapley_values(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """Rows of values, one for each feature: together a row's prediction less the base."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        if leaf.features:
            out[:, leaf.features] += leaf_values(leaf, x)
    return out


def tree_attribution(model: PipelineModel, df: DataFrame, columns: Sequence[str], key: str = "file") -> DataFrame:
    """Rows (key, feature, value, base) for every row of ``df`` and column: exact path-dependent Shapley values of the model's last stage.

    A row's values and the base sum to its risk for a forest, and to half the
    log-odds of its risk for boosted trees. The model, as large as executors
    hold it when they score, is broadcast; every row is passed once. A model of
    single leaves gives zeros; no rows give none.
    """
    spark, final = df.sparkSession, model.stages[-1]
    leaves, base = ensemble(final, spark)
    shared = spark.sparkContext.broadcast(leaves)
    x = df
    for stage in model.stages[:-1]:
        x = stage.transform(x)
    rows = x.select(F.col(key).alias("_key"), vector_to_array("features").alias("x"))
    kind = dict(rows.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = shapley_values(shared.value, np.array(batch.column(1).to_pylist(), dtype=np.float64))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["_key", "values"])

    names = F.array(*[F.lit(c) for c in columns])
    each = rows.mapInArrow(run, f"_key {kind}, values array<double>").select("_key", F.posexplode("values").alias("_i", "value"))
    return each.select(F.col("_key").alias(key), F.get(names, F.col("_i")).alias("feature"), "value", F.lit(base).alias("base"))
