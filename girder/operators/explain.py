"""Attribution of fitted tree ensembles as a set-based pass: exact path-dependent Shapley values for all rows of a table.

Every leaf of every tree is a row of arrays: its value, the features on its path and the share of training weight that passes each of them. For a
batch of rows, a leaf's path becomes a bit mask for each row (which of the leaf's features hold the row on the path). Rows of one mask have the same
attributions, so these are worked out once for each mask, from polynomials in the number of known features, and looked up: a leaf of few features keeps
the values of all its masks, one of many gets those that occur in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: A leaf of so many features keeps a table of all masks.
FEW = 8


class Leaf:
    """A leaf's weighted value, and for each of its features: (low, high] of the path, and the share of weight that stays on it."""

    def __init__(self, value: float, features: list[int], low: list[float], high: list[float], share: list[float]):
        self.value, self.features = value, features
        self.low, self.high, self.share = np.array(low), np.array(high), np.array(share)
        self.bits = 1 << np.arange(len(features), dtype=np.int64)
        self.table = self.values(np.arange(1 << len(features))) if 0 < len(features) <= FEW else None

    def values(self, masks: np.ndarray) -> np.ndarray:
        """The attributions of the leaf's features (columns) for each mask."""
        return self.value * mask_shares(((masks[:, None] & self.bits) > 0).astype(float), self.share)


def _walk(node, weight: float, value, path: dict) -> Iterator[Leaf]:
    if node.getClass().getSimpleName() == "LeafNode":
        features = sorted(path)
        yield Leaf(weight * value(node), features, *[[path[f][k] for f in features] for k in range(3)])
        return
    split, total = node.split(), max(node.impurityStats().count(), 1)
    f, under, over = split.featureIndex(), node.leftChild(), node.rightChild()
    if split.getClass().getSimpleName() == "CategoricalSplit":  # Spark takes one-hot parts for categories 0 and 1
        left, right = sorted(split.leftCategories()), sorted(split.rightCategories())
        if sorted([left, right]) != [[0.0], [1.0]]:
            raise ValueError(f"feature {f} splits on more categories than 0 and 1")
        t, (under, over) = 0.5, (under, over) if left == [0.0] else (over, under)
    else:
        t = float(split.threshold())
    low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
    for child, bounds in ((under, (low, min(high, t))), (over, (max(low, t), high))):
        yield from _walk(child, weight, value, path | {f: (*bounds, share * child.impurityStats().count() / total)})


def leaves_of(model) -> list[Leaf]:
    """The leaves of a fitted Spark ML tree ensemble or tree, weighted so that the values of the leaves a row reaches add up to what it explains.

    That is the prediction of a regression, the probability of class 1 of a forest or tree of classes, and the margin of a boosted
    classifier. Splits must be on numbers or on one-hot parts; a split on other categories raises ValueError.
    """
    if isinstance(model, PipelineModel):
        model = model.stages[-1]
    name = type(model).__name__
    trees = [t._java_obj for t in model.trees] if hasattr(model, "trees") else [model._java_obj]
    weights = [1.0 / len(trees)] * len(trees) if name.startswith("RandomForest") else list(getattr(model, "treeWeights", [1.0]))
    classes = name in ("RandomForestClassificationModel", "DecisionTreeClassificationModel")

    def share(node) -> float:
        stats = list(node.impurityStats().stats())
        return stats[1] / max(sum(stats), 1e-300) if len(stats) > 1 else 0.0

    value = share if classes else (lambda node: float(node.prediction()))
    return [leaf for tree, w in zip(trees, weights, strict=True) for leaf in _walk(tree.rootNode(), float(w), value, {})]


def expected(leaves: list[Leaf]) -> float:
    """What the ensemble says of a row of which nothing is known."""
    return float(sum(leaf.value * leaf.share.prod() for leaf in leaves))


def mask_shares(on: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley shares of a leaf of value 1, for each row of `on` (whether each of its features holds the row on the path)."""
    n, m = on.shape
    out = np.zeros((n, m))
    for f in range(m):
        poly = np.zeros((n, m))  # by number of known other features
        poly[:, 0] = 1.0
        for k, g in enumerate(x for x in range(m) if x != f):
            known = poly[:, : k + 1] * on[:, g, None]
            poly[:, : k + 1] *= share[g]
            poly[:, 1 : k + 2] += known
        weights = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
        out[:, f] = (poly @ weights) * (on[:, f] - share[f])
    return out


def attributions(leaves: list[Leaf], x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Shapley values of the rows of x (rows x features). A missing value (NaN) goes right at every split, as Spark's trees send it."""
    out = np.zeros(x.shape) if out is None else out
    columns = np.ascontiguousarray(np.where(np.isnan(x), np.inf, x).T)
    for leaf in leaves:
        if not leaf.features:
            continue
        place = np.zeros(len(x), np.int64)
        for f, low, high, bit in zip(leaf.features, leaf.low, leaf.high, leaf.bits, strict=True):
            on = columns[f] > low
            if not np.isinf(high):
                on &= columns[f] <= high
            place += bit * on
        table = leaf.table
        if table is None:
            masks, place = np.unique(place, return_inverse=True)
            table = leaf.values(masks)
        for k, f in enumerate(leaf.features):
            out[:, f] += table[place, k]
    return out


def tree_attributions(rows: DataFrame, key: str | list[str], features: str, names: list[str], model, chunk: int = 4096) -> DataFrame:
    """(key, feature, value, attribution): one row for each key and feature. `features` is a vector or array column, `names` its parts in order.

    The attributions of a key add up to what `leaves_of` explains less `expected`. Leaves travel with the task; nothing is shuffled.
    A row whose vector is null is left out; repeated keys are each explained; an empty table gives an empty result.
    """
    from pyspark.ml.functions import vector_to_array

    keys = [key] if isinstance(key, str) else list(key)
    leaves = leaves_of(model)
    array = F.col(features) if rows.schema[features].dataType.simpleString().startswith("array") else vector_to_array(features)
    own = rows.where(F.col(features).isNotNull()).select(*keys, array.cast("array<double>").alias("__x"))
    shared = rows.sparkSession.sparkContext.broadcast(leaves)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                vectors = part.column(len(keys)).fill_null([]) if part.column(len(keys)).null_count else part.column(len(keys))
                x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float).reshape(part.num_rows, len(names))
                phi = attributions(shared.value, x)
                index = pa.array(np.repeat(np.arange(part.num_rows), len(names)))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k).take(index) for k in range(len(keys))], pa.array(np.tile(np.array(names, object), part.num_rows), pa.string()), pa.array(x.ravel()), pa.array(phi.ravel())],
                    names=[*keys, "feature", "value", "attribution"],
                )

    schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys], "feature string, value double, attribution double"])
    return own.mapInArrow(work, schema)


def grouped(explained: DataFrame, key: str | list[str], groups: dict[str, str]) -> DataFrame:
    """Attributions of parts added up to the columns they come from (one-hot parts to their column); parts not in `groups` keep their name."""
    keys = [key] if isinstance(key, str) else list(key)
    names = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair]) if groups else None
    feature = F.coalesce(names[F.col("feature")], F.col("feature")) if groups else F.col("feature")
    return explained.groupBy(*keys, feature.alias("feature")).agg(F.sum("attribution").alias("attribution"))
