import pytest

from girder.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, float(k % 17), float((k * 7) % 13) if k % 9 else None, "abc"[k % 3] if k % 8 else None, int(k % 17 + (k * 7) % 13 > 14), float(k % 17) * 3 + (k * 7) % 13) for k in range(240)]
    return spark.createDataFrame(data, "k int, a double, b double, c string, y int, z double").cache()


@pytest.mark.parametrize("family", ["logistic", "forest", "boosted"])
def test_classifiers(rows, family):
    model, med = models.fitted(rows, models.classifier(family, "y", 240), ["a", "b"], ["c"])
    scored = model.transform(models.filled(rows, med, ["c"])).withColumn("p", models.probability())
    m = models.evaluated(scored, "y", "classification").first()
    assert m["roc_auc"] > 0.85


@pytest.mark.parametrize("family", ["linear", "forest", "boosted"])
def test_regressors(rows, family):
    model, med = models.fitted(rows, models.regressor(family, "z"), ["a", "b"], ["c"])
    m = models.evaluated(model.transform(models.filled(rows, med, ["c"])), "z", "regression").first()
    assert m["r2"] > 0.8


def test_tree_attributions_add_up(spark, rows):
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=["a", "k"], outputCol="features").transform(rows.withColumn("z2", rows["z"]))
    model = models.regressor("forest", "z", numTrees=4, maxDepth=4).fit(v)
    leaves = models.tree_leaves(model)
    total = sum(w for w, _ in leaves)

    def expected(paths):
        out = 0.0
        for value, path in paths:
            share = 1.0
            for *_, p in path:
                share *= p
            out += value * share
        return out

    base = sum(w * expected(p) for w, p in leaves) / total
    for r in model.transform(v).limit(5).collect():
        phi = models.tree_attribution(leaves, [float(x) for x in r["features"]], 2)
        assert base + sum(phi) / total == pytest.approx(r["prediction"])


def test_linear_attributions_rank(rows):
    known = rows.na.fill(0.0)
    got = models.linear_attribution(known, "k", {"a": 2.0, "b": -1.0}, known)
    assert got.count() == 480
    top = models.strongest(got, "k", 1)
    assert top.count() == 240 and {r["direction"] for r in top.select("direction").distinct().collect()} <= {"increases", "decreases", "negligible"}
    assert [r["feature"] for r in models.global_ranking(got).collect()] == ["a", "b"]


def test_selection_prefers_a_small_gap():
    c = [{"validation": 0.90, "train": 0.99, "trees": 5}, {"validation": 0.897, "train": 0.91, "trees": 9}, {"validation": 0.5, "train": 0.5}]
    assert models.selected(c)["trees"] == 9
    assert models.fit_flags(0.99, 0.80, 0.79) == {"overfit": True, "suspicious": False}
