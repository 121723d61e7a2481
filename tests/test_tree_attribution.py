"""Shapley values of trees against the definition over all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from defectloom.ml import models as ML
from defectloom.ml import tree_attribution as T

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((300, 4)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 2] > 0)) | (rng.random(300) < 0.1)
    return spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "file long, a double, b double, c double, d double, buggy int").cache()


def expected(nodes, kind, x, known, at=0):
    """The tree's mean prediction when only the known features are."""
    node = nodes[at]
    if node["leftChild"] < 0:
        return T._value(node, kind)
    s = node["split"]
    f, values = s["featureIndex"], s["leftCategoriesOrThreshold"]
    if f in known:
        left = x[f] <= values[0] if s["numCategories"] < 0 else x[f] in values
        return expected(nodes, kind, x, known, node["leftChild"] if left else node["rightChild"])
    return sum(T._cover(nodes[c], kind) / T._cover(node, kind) * expected(nodes, kind, x, known, c) for c in (node["leftChild"], node["rightChild"]))


def by_definition(trees, weights, kind, x):
    d, out = len(x), np.zeros(len(x))
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for n in range(d):
            for known in combinations(rest, n):
                w = factorial(n) * factorial(d - n - 1) / factorial(d)
                for nodes, weight in zip(trees, weights):
                    out[i] += w * weight * (expected(nodes, kind, x, {*known, i}) - expected(nodes, kind, x, set(known)))
    return out


@pytest.mark.parametrize(("kind", "sizes"), [("rf", {"numTrees": 4, "maxDepth": 4}), ("gbt", {"maxIter": 4, "maxDepth": 3}), ("rf", {"numTrees": 30, "maxDepth": 7}), ("gbt", {"maxIter": 10, "maxDepth": 6, "stepSize": 0.05})])
def test_values_sum_to_the_risk_and_equal_the_definition(spark, table, kind, sizes):
    model = ML.fit(table, COLS, kind, sizes=sizes)
    rows = T.tree_attribution(model, table, COLS).collect()
    risks = {r["file"]: r["risk"] for r in ML.score(model, table, COLS).collect()}
    values = {i: {} for i in risks}
    for r in rows:
        values[r["file"]][r["feature"]] = r["value"]
    base = rows[0]["base"]
    for i, risk in risks.items():
        raw = risk if kind == "rf" else 0.5 * np.log(risk / (1 - risk))
        assert base + sum(values[i].values()) == pytest.approx(raw, abs=1e-9)
    last = model.stages[-1]
    trees = T.tree_nodes(last, spark)
    weights = list(last.treeWeights) if kind == "gbt" else [1 / len(trees)] * len(trees)
    x = model.stages[1].transform(model.stages[0].transform(table.where("file < 12"))).select("file", vector_to_array("features").alias("x")).collect()
    for r in x[: 12 if len(trees) < 9 else 2]:
        expect = by_definition(trees, weights, "value" if kind == "gbt" else "class", r["x"])
        assert np.allclose([values[r["file"]][c] for c in COLS], expect, atol=1e-9)


def test_categories(spark, table):
    t = table.withColumn("word", F.element_at(F.array(*[F.lit(w) for w in ("x", "y", "z", "w", "v")]), (F.col("file") % 5 + 1).cast("int"))).withColumn("buggy", F.when(F.col("word").isin("y", "v"), F.col("buggy")).otherwise(1 - F.col("buggy")).cast("int"))
    for c in (DecisionTreeClassifier(labelCol="buggy", maxDepth=5), RandomForestClassifier(labelCol="buggy", numTrees=3, maxDepth=5, seed=1), GBTClassifier(labelCol="buggy", maxIter=3, maxDepth=4)):
        model = Pipeline(stages=[StringIndexer(inputCol="word", outputCol="wi"), VectorAssembler(inputCols=["wi", "a", "b"], outputCol="features"), c]).fit(t)
        trees = T.tree_nodes(model.stages[-1], spark)
        assert any((n["split"] or {}).get("numCategories", -1) > 0 for nodes in trees for n in nodes.values())
        kind = "value" if isinstance(c, GBTClassifier) else "class"
        weights = list(model.stages[-1].treeWeights) if kind == "value" else [1 / len(trees)] * len(trees)
        got = {(r["file"], r["feature"]): r["value"] for r in T.tree_attribution(model, t.where("file < 8"), ["word", "a", "b"]).collect()}
        for r in model.stages[1].transform(model.stages[0].transform(t.where("file < 8"))).select("file", vector_to_array("features").alias("x")).collect():
            assert np.allclose([got[r["file"], f] for f in ("word", "a", "b")], by_definition(trees, weights, kind, r["x"]), atol=1e-9)


def test_long_paths_and_single_leaves(spark, table):
    zero = np.array([0.5] * 14)
    patterns = np.random.default_rng(1).integers(0, 2, (20, 14)).astype(float)
    values = T.pattern_values(patterns, zero)
    assert np.allclose(values.sum(axis=1), patterns.prod(axis=1) - zero.prod())  # they share out the difference
    leaf = T.Leaf(2.0, 0.5, list(range(14)), zero.tolist(), [(0.5, np.inf, None)] * 14)
    assert np.allclose(T.leaf_values(leaf, patterns), 2 * values)
    one = ML.fit(table, COLS, "rf", sizes={"numTrees": 2, "maxDepth": 0})
    rows = T.tree_attribution(one, table, COLS).collect()
    assert {r["value"] for r in rows} == {0.0} and len(rows) == 1200
    assert T.tree_attribution(one, table.limit(0), COLS).count() == 0
