"""Model pipelines on Spark ML: preprocessing, the model families, selection, scoring and attribution."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.operators.measures import classification_metrics, ranking_metrics, regression_metrics
from girder.operators.quantiles import median_of, quantiles


def medians(train: DataFrame, numeric: list[str]) -> dict[str, float]:
    """Exact medians of known values."""
    found = {r["column"]: r["marks"][0] for r in quantiles(train, numeric, [0.5]).collect()} if numeric else {}
    return {c: found[c] if found[c] is not None else 0.0 for c in numeric}


def filled(rows: DataFrame, medians_: dict[str, float], text: list[str]) -> DataFrame:
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians_.items()})
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit("Unknown")) for c in text})


def preprocessing(numeric: list[str], text: list[str]) -> list:
    """Scaled numbers and one-hot texts (unseen values get no column) as `features`."""
    stages = [VectorAssembler(inputCols=numeric, outputCol="__num"), StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True, withStd=True)]
    for c in text:
        stages += [StringIndexer(inputCol=c, outputCol=f"__{c}_i", handleInvalid="keep"), OneHotEncoder(inputCol=f"__{c}_i", outputCol=f"__{c}_v", handleInvalid="keep")]
    return [*stages, VectorAssembler(inputCols=["__scaled", *[f"__{c}_v" for c in text]], outputCol="features")]


def classifier(family: str, label: str, n: int, **options):
    """logistic (L2 with C = 1), forest or boosted."""
    if family == "logistic":
        return LogisticRegression(labelCol=label, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, maxIter=200)
    if family == "forest":
        return RandomForestClassifier(labelCol=label, **{"numTrees": 50, "maxDepth": 8, "seed": 42, **options})
    return GBTClassifier(labelCol=label, **{"maxIter": 20, "maxDepth": 4, "seed": 42, **options})


def regressor(family: str, label: str, **options):
    if family == "linear":
        return LinearRegression(labelCol=label, solver="normal", regParam=1e-9)
    if family == "forest":
        return RandomForestRegressor(labelCol=label, **{"numTrees": 50, "maxDepth": 8, "seed": 42, **options})
    return GBTRegressor(labelCol=label, **{"maxIter": 20, "maxDepth": 4, "seed": 42, **options})


def fitted(train: DataFrame, model, numeric: list[str], text: list[str]):
    """A fitted pipeline and the medians it was fed with."""
    m = medians(train, numeric)
    return Pipeline(stages=[*preprocessing(numeric, text), model]).fit(filled(train, m, text)), m


def probability(c: str = "probability") -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.get(vector_to_array(c), F.lit(1))


def evaluated(rows: DataFrame, y: str, kind: str) -> DataFrame:
    """The metrics of scored rows: prediction, and for classes a probability p."""
    if kind == "regression":
        return regression_metrics(rows, y, "prediction")
    return classification_metrics(rows, y, "prediction").join(F.broadcast(ranking_metrics(rows, y, "p")))


def selected(candidates: list[dict], epsilon: float = 0.005) -> dict:
    """Among candidates whose validation metric is within epsilon of the best, the smallest train-validation gap, then the fewest trees."""
    best = max(c["validation"] for c in candidates)
    near = [c for c in candidates if best - c["validation"] <= epsilon]
    return min(near, key=lambda c: (c["train"] - c["validation"], c.get("trees", 0)))


def fit_flags(train: float, validation: float, test: float, overfit: float = 0.10, suspicious: float = 0.98) -> dict[str, bool]:
    return {"overfit": train - validation > overfit, "suspicious": max(validation, test) > suspicious}


def baselines(rows: DataFrame, y: str) -> DataFrame:
    """What predicts without features: majority class (of equally frequent ones the least), mean and median."""
    counts = rows.where(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("__n"))
    majority = counts.agg(F.min_by(y, F.struct(-F.col("__n"), F.col(y))).alias("majority"))
    return majority.join(F.broadcast(rows.agg(F.avg(y).alias("mean")))).join(F.broadcast(median_of(rows, F.col(y), "median")))


# ---------------------------------------------------------------- attribution


def linear_attribution(rows: DataFrame, key: str, coefficients: dict[str, float], background: DataFrame) -> DataFrame:
    """(key, feature, value, attribution): coefficient times distance from the background's mean, for each feature."""
    means = background.agg(*[F.avg(c).alias(f"__m_{c}") for c in coefficients])
    parts = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), (F.lit(w) * (F.col(c) - F.col(f"__m_{c}"))).alias("attribution")) for c, w in coefficients.items()]
    return rows.join(F.broadcast(means)).select(key, F.inline(F.array(*parts)))


def strongest(attributions: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The n largest attributions of each key by size, ranked, with a direction."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.abs("attribution").desc(), "feature")
    rows = attributions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    a = F.col("attribution")
    return rows.withColumn("direction", F.when(a > 0, "increases").when(a < 0, "decreases").otherwise("negligible"))


def global_ranking(attributions: DataFrame, n: int = 15) -> DataFrame:
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs")).orderBy(F.desc("mean_abs"), "feature").limit(n)


def _node_paths(node, path=()):
    """Leaves of a Spark ML tree as (value, weight, [(feature, threshold, goes left, share of the node's weight)])."""
    weight = node.impurityStats().count()
    if node.getClass().getSimpleName() == "LeafNode":
        return [(float(node.prediction()), path)]
    s, out = node.split(), []
    for left, child in ((True, node.leftChild()), (False, node.rightChild())):
        out += _node_paths(child, (*path, (s.featureIndex(), float(s.threshold()), left, child.impurityStats().count() / max(weight, 1))))
    return out


def tree_leaves(model) -> list:
    """The leaves of all trees of a fitted ensemble, with the trees' weights."""
    java = model._java_obj.trees()
    return [(float(w), _node_paths(java[k].rootNode())) for k, w in enumerate(model.treeWeights)]


def tree_attribution(leaves: list, x: list[float], n_features: int) -> list[float]:
    """Exact path-dependent Shapley values of one row; they add up to the prediction less the expected value.

    For each leaf, the features on its path either hold the row on it (1), off it (0), or, when unknown, pass the leaf's share;
    the Shapley weights of subsets come from a polynomial in the number of known features.
    """
    from math import factorial

    phi = [0.0] * n_features
    for weight, paths in leaves:
        for value, path in paths:
            one: dict[int, float] = {}
            share: dict[int, float] = {}
            for f, threshold, left, p in path:
                one[f] = one.get(f, 1.0) * float((x[f] <= threshold) == left)
                share[f] = share.get(f, 1.0) * p
            feats = list(one)
            m = len(feats)
            for f in feats:
                poly = [1.0]  # coefficient k: sum over subsets of k known other features
                for g in feats:
                    if g != f:
                        poly = [(poly[k] if k < len(poly) else 0.0) * share[g] + (poly[k - 1] * one[g] if k else 0.0) for k in range(len(poly) + 1)]
                total = sum(c * factorial(k) * factorial(m - k - 1) / factorial(m) for k, c in enumerate(poly))
                phi[f] += weight * value * total * (one[f] - share[f])
    return phi
