"""Tree attributions against all subsets of features, and their sum against the prediction."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from girder.operators import explain

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)).round(2)
    y = 2 * x[:, 0] + np.where(x[:, 1] > 0, x[:, 2], -1) + 0.1 * x[:, 3]
    rows = [(k, *map(float, v), float(t), float(t > 0)) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, y double, label double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).cache()


def brute(leaves, x):
    """Shapley values by all subsets: a leaf counts fully, not at all, or by its shares where features are unknown."""

    def value(known):
        total = 0.0
        for leaf in leaves:
            v = leaf.value
            for f, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share, strict=True):
                v *= float(low < x[f] <= high) if f in known else share
            total += v
        return total

    n, out = len(x), []
    for f in range(n):
        rest = [g for g in range(n) if g != f]
        out.append(sum(factorial(k) * factorial(n - k - 1) / factorial(n) * (value({*s, f}) - value(set(s))) for k in range(n) for s in combinations(rest, k)))
    return out


@pytest.mark.parametrize("kind", ["tree", "forest", "boosted", "classes", "margin"])
def test_sums_and_subsets(vectors, kind):
    learner = {"tree": DecisionTreeRegressor(labelCol="y", maxDepth=4), "forest": RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=4, seed=1), "boosted": GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, seed=1), "classes": RandomForestClassifier(numTrees=4, maxDepth=4, seed=1), "margin": GBTClassifier(maxIter=4, maxDepth=3, seed=1)}[kind]
    model = learner.fit(vectors)
    leaves, base = explain.leaves_of(model), explain.expected(explain.leaves_of(model))
    got = explain.tree_attributions(vectors, "k", "features", NAMES, model)
    assert got.count() == 300 * 4
    by = {r["k"]: r for r in got.groupBy("k").agg(F.sum("attribution").alias("s"), F.collect_list(F.struct("feature", "attribution")).alias("each")).collect()}
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(vectors)
    said = {"classes": "probability", "margin": "rawPrediction"}.get(kind)
    scored = scored.withColumn("said", F.get(vector_to_array(said), 1) if said else F.col("prediction"))
    for r in scored.select("k", "features", "said").collect():
        assert by[r["k"]]["s"] + base == pytest.approx(r["said"], abs=1e-9)
        if r["k"] < 12:
            each = dict((e["feature"], e["attribution"]) for e in by[r["k"]]["each"])
            assert [each[n] for n in NAMES] == pytest.approx(brute(leaves, r["features"].toArray()), abs=1e-9)


def test_masks_of_a_long_path_and_a_repeated_feature():
    leaf = explain.Leaf(3.0, list(range(9)), [-np.inf] * 9, [0.0] * 9, [0.5] * 9)
    phi = explain.attributions([leaf], np.full((2, 9), -1.0))
    assert phi.sum(axis=1) == pytest.approx([3.0 - 3.0 * 0.5**9] * 2)
    again = explain.Leaf(1.0, [0], [-1.0], [1.0], [0.25])
    assert explain.attributions([again], np.array([[0.0], [2.0], [np.nan]])).ravel().tolist() == [0.75, -0.25, -0.25]


def test_parts_are_added_up_and_empty_tables(vectors):
    model = DecisionTreeRegressor(labelCol="y", maxDepth=2).fit(vectors)
    got = explain.tree_attributions(vectors, ["k", "label"], "features", NAMES, model)
    both = explain.grouped(got, "k", {"a": "ab", "b": "ab"})
    assert {r["feature"] for r in both.select("feature").distinct().collect()} == {"ab", "c", "d"}
    assert explain.tree_attributions(vectors.limit(0), "k", "features", NAMES, model).count() == 0


def test_a_leaf_of_few_features_keeps_its_masks(monkeypatch):
    leaf = explain.Leaf(2.0, [0, 2], [-np.inf, 1.0], [3.0, np.inf], [0.25, 0.5])
    assert leaf.table.shape == (4, 2)
    x = np.random.default_rng(1).normal(2, 2, (500, 3))
    x[::7, 2] = np.nan
    monkeypatch.setattr(np, "unique", lambda *a, **k: 1 / 0)  # no batch is sorted
    kept = explain.attributions([leaf], x)
    monkeypatch.undo()
    monkeypatch.setattr(explain, "FEW", 0)
    assert np.array_equal(kept, explain.attributions([explain.Leaf(2.0, [0, 2], [-np.inf, 1.0], [3.0, np.inf], [0.25, 0.5])], x))
    assert np.abs(kept).sum() > 0
